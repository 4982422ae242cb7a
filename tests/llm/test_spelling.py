import random
import zlib

import pytest

from evidara.llm import spelling
from evidara.llm.spelling import Trie, one_edit

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute(docs, shortest=6, least=5, much=5, damage=199):
    """Groups of (doc_id, text) by comparing every word with every other."""
    import re
    from collections import Counter

    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: best for w in n if near[w] and n[best := min(near[w], key=lambda x: (-n[x], x))] >= much * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def slow_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(before[j] + (x != y), before[j + 1] + 1, now[j] + 1))
        before = now
    return before[-1]


def test_automaton_accepts_what_is_one_edit_away():
    rng = random.Random(5)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 40))})
        n = [rng.randint(1, 99) for _ in words]
        trie = Trie.of(Trie(words, n).parts())
        for word in [*words, "", "a", "bbbbbbb"]:
            assert sorted(trie.near(word)) == [(w, k) for w, k in zip(words, n, strict=True) if slow_distance(w, word) == 1]


@pytest.mark.parametrize(("shard", "block"), [(20_000, 1_000_000), (2, 5)])
def test_variants_against_brute_force(spark, shard, block):
    rng = random.Random(7)
    stems = ["hälfte", "letter", "lettera", "abcdefg", "aaaaaaa", "aaaaaaaa", "zzzzzz", "zzzzzzz"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems[: 1 + rng.randrange(len(stems))])
            words.append(w.upper() if rng.random() < 0.1 else w[:2] + rng.choice("xyé") + w[3:] if rng.random() < 0.3 else w)
        docs.append((i if i % 9 else None, rng.choice([" ", "-", "1"]).join(words) if i % 13 else None))
    docs += docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows(spelling.group_variants(df, damage=7, shard=shard, block=block))
    assert got == brute(docs, damage=7) and any(r[1] for r in got)


def test_chain_of_forms(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 130, "aaabbb": 700, "aabbbb": 3600}
    text = " ".join(" ".join([w] * n) for w, n in counts.items())
    got = {r["word"]: r["root"] for r in spelling.group_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), damage=1 << 40).collect()}
    assert got == dict.fromkeys(counts, "aabbbb")


def test_edges_and_nothing(edge_docs, no_docs):
    assert rows(spelling.group_variants(edge_docs)) == brute([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert spelling.group_variants(no_docs).collect() == [] and spelling.group_variants(no_docs).columns == COLUMNS
