import random
import zlib

import numpy as np
import pytest

from evidara.llm import toxicity
from evidara.llm.toxicity import Codes, Lexicon, features, keys, pieces, plain

LEXICON = Lexicon(100, 100, {"grumblet": (50, 0), "grum*": (60, 1), "fine": (10, 90)})


def test_disguise_is_undone():
    assert [plain(w)[0] for w in ("Grumblet!", "gr-um-bl-et", "grum8let", "GRUUUMBLET", "1-2", "...", "d'accord")] == ["grumblet", "grumblet", "grumblet", "grumblet", "1-2", "", "daccord"]
    assert [plain(w)[1] for w in ("grumblet", "grum8let", "2008", "d'accord", "g.r.um")] == [False, True, False, False, True]
    assert keys("Grumblet,") == ["grumblet", "grum*", "grumb*", "grumbl*"] and keys("a") == [] and keys("x" * 99) == []


def test_a_document_does_not_witness_for_itself():
    held = Lexicon(1, 1, {"oddword": (1, 0)})
    assert held.weight("oddword") > 0 and held.weight("oddword", 1) == 0
    assert LEXICON.weight("grumblet", 0) > LEXICON.weight("grumblet", 1) > 3 and LEXICON.weight("fine") == 0


def test_features_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = "You are a GRUMBLET, you!! " * 400 + "g r u m b l e t é\n" * 30
    whole = features(text, Codes(LEXICON))
    assert "".join(pieces(text, 50)) == text
    monkeypatch.setattr(toxicity.pieces, "__defaults__", (1000,))
    assert np.allclose(features(text, Codes(LEXICON)), whole) and len(whole) == toxicity.N_FEATURES
    assert features(None, Codes(LEXICON)) == features(" \n", Codes(LEXICON)) == [0.0] * toxicity.N_FEATURES


def test_proximity_against_a_plain_count():
    rng = random.Random(2)
    words = [rng.choice(["you", "grumblet", *(["calm"] * 9)]) for _ in range(500)]
    found = features(" ".join(words), Codes(LEXICON))
    hits = [i for i, w in enumerate(words) if w == "grumblet"]
    near = sum("you" in words[max(i - 5, 0) : i + 6] for i in hits)
    densest = max(words[i : i + 20].count("grumblet") for i in range(len(words)))
    at = 2 * len(toxicity.LEVELS) + len(toxicity._ASCII)
    assert np.isclose(found[at + 1], near / len(hits)) and found[at + 4] == densest


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    syllables = ["ta", "mo", "re", "lin", "so", "ka", "ven", "du", "pi", "or"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    ends = ["", "s", "en", "ung", "ist", "ard"]
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = int(i % 6 == 0)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbl", "zwikk", "fnurg"]) + rng.choice(ends))
        docs.append((i, " ".join(words), None if i % 3 else "x"))
        labels.append((i, 1, toxic))
    docs += [(1, docs[1][1], "x"), (None, None, None), (1001, "", None), (1002, "grumblung fnurgard you " * 40_000, None), (1003, "gr.um.bl you fnur9s, zwikk", None)]
    labels += [(5000, 1, 1), (None, 1, 1), (3, None, None), (4, 0, 7)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents(planted):
    docs, labels = planted
    got = toxicity.score(docs, toxicity.learn(docs, labels, rounds=15, depth=3)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[1002] >= 0.5 and score[1003] >= 0.5 and score[1001] == score[None] < 0.5
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1


def test_one_kind_of_label_and_nothing(planted, edge_docs, no_docs):
    docs, labels = planted
    assert {r["score"] for r in toxicity.score(edge_docs, toxicity.learn(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    model = toxicity.learn(no_docs, labels.where("false"))
    assert {r["score"] for r in toxicity.score(edge_docs, model).collect()} == {0.5}
    assert toxicity.score(no_docs, model).count() == 0
