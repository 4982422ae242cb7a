"""A message that has nothing to say in a micro-batch costs no frame."""

import pandas as pd

from evidara.streaming.citations import _feed


class State:
    exists, get, new = False, None, None

    def update(self, new):
        self.new = new


def test_no_frame_without_pieces():
    deltas = lambda seq, text, final: pd.DataFrame({"seq": [seq], "delta": [text], "final": [final], "allowed": [["ev_1"]]})
    state = State()
    assert list(_feed(("m",), iter([deltas(1, "late", True)]), state)) == [] and state.new[6] == ["1:1:late"]
    (frame,) = _feed(("m",), iter([deltas(0, "a [[cite:ev_1]]", True)]), State())
    assert frame["message"].tolist() == ["m"] * 3 and frame["kind"].tolist() == ["text", "citation", "status"] and frame["part"].isna().tolist() == [False, False, True]
