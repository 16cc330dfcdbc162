import random
import time

import numpy as np
import pytest

from skein.llm import chunking, mixing, packing, tokens

WORDS = ["radar", "mast.", "e.g.", "No.", "runs!", "2.1.", "crew", "\n\n", "𝐀𝐁", "approx.", "x" * 90]


def walk(text, limit=1200, least=600, overlap=150):
    """The rule as it is written, step by step."""
    paragraphs, sentences, spaces = (set(map(int, x)) for x in chunking.boundaries(text))
    s, out = 0, []
    while len(text) - s > limit:
        e = s + limit
        for ends in (paragraphs, sentences, spaces):
            near = [x for x in range(s + least + 1, s + limit + 1) if x in ends]
            if near:
                e = near[-1]
                break
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(text))]


def sample(rng, n):
    parts = [rng.choice(WORDS) if rng.random() > 0.002 else "y" * rng.randint(500, 9000) for _ in range(n)]
    return " ".join(parts).replace(" \n\n ", "\n\n")


def test_pieces_against_walk(spark):
    rng = random.Random(4)
    texts = [sample(rng, rng.randint(300, 2500)) for _ in range(40)] + ["z" * 50_000, "short", "", None, " " * 5000, "a" * 1201, "a" * 1200]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id long, t string, chunk_idx string").repartition(3)
    got = {}
    for r in chunking.split_texts(df, "id", "t", with_text=True).collect():
        assert texts[r.id][r.char_start : r.char_end] == r.piece
        got.setdefault(r.id, []).append((r.chunk_idx, r.char_start, r.char_end))
    for i, t in enumerate(texts):
        want = walk(t) if t and len(t) > 1200 else []
        assert sorted(got.get(i, [])) == [(k, *x) for k, x in enumerate(want)]


def test_unbroken_passages_against_walk():
    rng = random.Random(14)
    for _ in range(60):
        text = "".join("x" * rng.randint(1, 4000) + rng.choice([" ", ". ", "\n\n", ""]) for _ in range(rng.randint(1, 12)))
        text += "y" * max(0, 1201 - len(text))
        which, s, e = chunking.cuts([text, "z" * 2500, text], 1200, 600, 150)
        for k, t in enumerate((text, "z" * 2500, text)):
            assert list(zip(s[which == k].tolist(), e[which == k].tolist(), strict=True)) == walk(t)


def test_long_unbroken_text_is_quick():
    start = time.perf_counter()
    _, s, e = chunking.cuts(["q" * 50_000_000], 1200, 600, 150)
    assert time.perf_counter() - start < 5 and len(s) == -(-(50_000_000 - 1200) // 1050) + 1 and e[-1] == 50_000_000
    assert (s[1:] == e[:-1] - 150).all() and (e - s <= 1200).all()


def test_sentences_and_abbreviations():
    text = "2.1. First e.g. one. Second No. 5? Third i.e. x!\n\n3. approx. 4."
    _, ends, _ = chunking.boundaries(text)
    assert [text[:e][-6:] for e in ends] == [" one.", "No. 5?", "e. x!", "ox. 4."] or [text[e - 1] for e in ends] == [".", "?", "!", "."]


def test_pieces_of_repeated_rows_and_bad_limits(spark):
    df = spark.createDataFrame([(1, "w " * 1000), (1, "w " * 1000)], "id long, t string")
    assert chunking.split_texts(df, "id", "t").count() == 2 * len(walk("w " * 1000))
    with pytest.raises(ValueError):
        chunking.split_texts(df, "id", "t", 100, 100, 10)


def test_pack_sizes_fill_and_never_overflow():
    rng = np.random.default_rng(5)
    for n in (1, 7, 500, 4000):
        sizes = rng.integers(1, 4097, n)
        where, kinds = packing.pack_sizes(sizes, 4096)
        room = np.bincount(where, weights=sizes, minlength=len(kinds))
        assert room.max() <= 4096 and len(where) == n and (np.bincount(where, minlength=len(kinds)) > 0).all()
        big = np.array([s for s in sizes])
        assert len(kinds) <= 1.25 * big.sum() / 4096 + 2 or n < 10
    same, kinds = packing.pack_sizes(np.full(100, 1000), 4096)  # class 4: four of each
    assert len(kinds) == 25 and set(np.bincount(same)) == {4}


def test_pack_divides_only_oversized(spark):
    rows = [(1, 10_000), (2, 4096), (3, 1), (4, 0), (5, None), (6, 4097), (3, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens long").coalesce(1), "doc_id", "tokens").collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.piece_tokens)
    assert sorted(by[1], reverse=True) == [4096, 4096, 1808] and by[2] == [4096] and by[3] == [1, 1] and sorted(by[6]) == [1, 4096] and not {4, 5} & set(by)
    full = {}
    for r in got:
        full[r.container_id] = full.get(r.container_id, 0) + r.piece_tokens
    assert max(full.values()) <= 4096
    assert {r.doc_id for r in packing.oversized(spark.createDataFrame(got)).collect()} == {1, 6}
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens long"), "doc_id", "tokens").count() == 0


def test_small_tasks_leave_little_room(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(i, max(1, int(rng.lognormvariate(6, 1.2)))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    size = sum(n for _, n in rows)
    for tasks, fan_in, least in ((1, 64, 0.98), (64, 64, 0.97), (64, 4, 0.97)):
        monkeypatch.setattr(packing, "FAN_IN", fan_in)
        got = packing.pack(df.repartition(tasks), "doc_id", "tokens").collect()
        full, pieces = {}, {}
        for r in got:
            full[r.container_id] = full.get(r.container_id, 0) + r.piece_tokens
            pieces.setdefault(r.doc_id, []).append((r.piece, r.piece_tokens, r.n_pieces))
        assert max(full.values()) <= 4096 and size / (4096 * len(full)) >= least
        for i, n in rows:
            assert [p for p, _, _ in sorted(pieces[i])] == list(range(-(-n // 4096))) and sum(t for _, t, _ in pieces[i]) == n


def test_long_texts_count_as_whole_ones():
    from pathlib import Path

    raw = Path(tokens.VOCABULARY).read_bytes()
    count = tokens.encoder(raw)
    text = ("The crew checks 12 masts, e.g. radar masts!  \n" * 12_000)[:500_000]
    part = tokens.PART
    try:
        tokens.PART = 10**9
        whole = count(text)
    finally:
        tokens.PART = part
    assert count(text) == whole and count("") == 0


def test_pivot_keeps_mass():
    rng = np.random.default_rng(6)
    p, w = rng.random(500), rng.integers(1, 900, 500).astype(float)
    q, at = mixing.pivot(p, w, rng)
    assert abs((p * w).sum() - (q * w).sum()) < 1e-6 and all(x in (0, 1) for i, x in enumerate(q) if i != at)
    drawn = np.mean([mixing.pivot(np.full(20, 0.3), np.ones(20), np.random.default_rng(i))[0].round() for i in range(300)], axis=0)
    assert abs(drawn.mean() - 0.3) < 0.02 and drawn.min() > 0.15 and drawn.max() < 0.45


def test_mix(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot"] * 6 + ["b", "c", "other", None]), rng.randint(0, 300)) for i in range(3000)]
    targets = [("hot", 0.4, 1), ("b", 0.3, 5), ("c", 0.2, 2), ("empty", 0.1, 3)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    goals = spark.createDataFrame(targets, "source string, target_share double, max_uses int")
    caps = {s: m for s, _, m in targets}
    size = {s: sum(n for _, x, n in rows if x == s) for s, _, _ in targets}
    total = sum(size.values())
    for bucket, fan_in in ((50_000, 64), (100, 64), (20, 3)):
        monkeypatch.setattr(mixing, "BUCKET", bucket)
        monkeypatch.setattr(mixing, "FAN_IN", fan_in)
        used, report = mixing.mix(sized.repartition(6), goals)
        got = {r.source: r for r in report.collect()}
        for s, share, most in targets:
            assert got[s].short == (most * size[s] < share * total)
            assert abs(got[s].reached - min(share * total, most * size[s])) <= 300
        mixed = sorted(map(tuple, used.collect()))
        assert all(0 < copies <= caps[source] for _, source, _, copies in mixed) and len({i for i, *_ in mixed}) == len(mixed)
        assert abs(sum(r.share for r in got.values()) - 1) < 1e-9
        for other in (sized.coalesce(1), sized.repartition(7, "tokens")):  # the same mix however the input is divided
            assert sorted(map(tuple, mixing.mix(other, goals)[0].collect())) == mixed


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, tokens long")
    used, report = mixing.mix(empty, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_uses int"))
    assert used.count() == 0 and [(r.reached, r.share) for r in report.collect()] == [(0, 0.0)]


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "two words", "k"), (2, None, "k"), (3, "", None)], "doc_id long, text string, tokens string")
    got = {r.doc_id: r.tokens for r in tokens.token_sizes(df, "text", ["doc_id"]).collect()}
    assert got == {1: 2, 2: 0, 3: 0}
