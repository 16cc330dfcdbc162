import random
import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from skein.operators import items as I
from skein.operators import providers as P
from skein.operators import similarity as M
from skein.operators import stats as A

ITEM = "doc_code string, ord long, text string, item_type string, confidence double, source string, esco_id string, evidence string"


def frame(spark, rows):
    return spark.createDataFrame([(d, o, t, k, c, "s", e, None) for d, o, t, k, c, e in rows], ITEM)


def test_quality_filter_lengths(spark):
    rows = [("a", i, "x" * n, k, 0.5, None) for i, (n, k) in enumerate((n, k) for n in (2, 3, 80, 81, 150, 151) for k in ("skill", "knowledge"))]
    rows += [("a", 90, "Business  Intelligence", "skill", 0.9, None), ("a", 91, None, "skill", 0.9, None), ("a", 92, "XXX", "skill", 0.9, None)]
    got = {(len(r.text), r.item_type) for r in I.quality_filter(frame(spark, rows)).collect()}
    assert got == {(3, "skill"), (80, "skill"), (3, "knowledge"), (80, "knowledge"), (81, "knowledge"), (150, "knowledge")}


def test_strict_and_bias(spark):
    rows = [("a", 1, "plain words", "skill", 0.1, None), ("a", 2, "target words", "skill", 0.1, None), ("a", 3, "more words", "skill", 0.1, "E1"), ("a", 4, "other words", "ability", None, None), ("a", 5, "sure words", "skill", 0.9, " ")]
    ids = lambda **k: sorted(r.ord for r in I.quality_filter(frame(spark, rows), **k).collect())
    assert ids(strict=True) == [3, 4, 5] and ids(domain_bias=True) == [2, 4, 5]


def test_empty_table(spark):
    empty = frame(spark, [])
    assert I.quality_filter(empty).count() == 0 and M.greedy_clusters(empty).count() == 0 and A.issues(empty).count() == 4


def brute(rows, threshold=0.86):
    """The leader of each text, by comparing with every leader in order; forms are the texts in lower case without marks."""
    form = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    groups = {}
    for d, o, t, k, c, e in rows:
        groups.setdefault((d, k), {}).setdefault(t or "", []).append((bool((e or "").strip()), c or 0.0, -o))
    out = {}
    for key, texts in groups.items():
        order = sorted(((max(v), t) for t, v in texts.items()), key=lambda x: (-x[0][0], -x[0][1], -len(x[1]), -x[0][2]))
        leaders = []
        for best, t in order:
            f = form(t)
            for lead, o in leaders:
                a, b = set(f.split()), set(lead.split())
                j = len(a & b) / len(a | b) if a | b else 1.0
                if len(t) >= 4 and 0.6 * j + 0.4 * SequenceMatcher(None, f, lead).ratio() >= threshold:
                    out[key + (t,)] = o
                    break
            else:
                leaders.append((f, -best[2]))
                out[key + (t,)] = -best[2]
    return out


def test_clusters_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = []
    for i in range(500):
        ws = rng.sample(words, rng.randint(0, 7))
        text = rng.choice([" ", "-"]).join(ws) if rng.random() > 0.15 else rng.choice(["abc", "", "ab", "ab-", "AB  .", "a-b", "....", "?"])
        rows.append((rng.choice(["a", "b", None]), i, text, rng.choice(["skill", "ability"]), rng.choice([0.1, 0.5, 0.9]), rng.choice([None, "E1"])))
    want = brute(rows)
    for at_once in (10**6, 40, 0):
        monkeypatch.setattr(M, "OPEN_AT_ONCE", at_once)
        got = {(r.doc_code, r.item_type, r.text): r.leader_ord for r in M.greedy_clusters(frame(spark, rows)).collect()}
        assert got == want


def test_canonical_items_of_equal_places(spark):
    """Places are unique in a document only: another document's id at the same place is never lifted."""
    rows = [("a", 1, "run radar sets", "skill", 0.5, None), ("b", 1, "paint masts", "skill", 0.5, "E1"), ("a", 1, "know maps", "knowledge", 0.5, "E2")]
    got = {(r.doc_code, r.item_type, r.leader_ord, r.text, r.esco_id, r.n_members) for r in M.canonical_items(frame(spark, rows)).collect()}
    assert got == {("a", "skill", 1, "run radar sets", None, 1), ("b", "skill", 1, "paint masts", "E1", 1), ("a", "knowledge", 1, "know maps", "E2", 1)}


def test_hybrid_is_asymmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(M.char_ratio("a", "b")).collect()] == [0.25, 0.5, 1.0, None]
    assert [round(r[0], 3) for r in df.limit(3).select(M.hybrid("a", "b")).collect()] == [0.1, 0.2, 1.0]


def test_alignment(spark):
    cat = spark.createDataFrame([("E1", "operate radar sets", "run radar sets; ; radar set operation"), ("E2", "operate sonar sets", None), ("E3", None, "x"), ("E4", "inspect long pipelines daily", "a;b;c;d;e;f;g;h;ninth alternative here")], "esco_id string, label string, alt_labels string")
    rows = [("a", 1, "Operate Radar-Sets", "skill", 0.1, None), ("a", 2, "Ability to run radar sets", "ability", 0.1, None), ("a", 3, "operate sonar", "skill", 0.1, None), ("a", 4, "ninth alternative here", "skill", 0.1, None), ("a", 5, "xy", "skill", 0.1, None)]
    assert {(r.ord, r.esco_id, round(r.score, 3)) for r in M.align(frame(spark, rows), cat).collect()} == {(1, "E1", 1.0), (2, "E1", 1.0)}


def test_sanitize_parse_and_guard(spark):
    reply = "- knowledge of radar.\n- Knowledge of Radar\n- ability to run\nnoise\n- Ability to " + "x" * 130 + "\n  - Knowledge of maps;"
    df = spark.createDataFrame([("a", reply), ("b", None)], "doc_code string, reply string")
    lines = P.sanitized(df, "doc_code", "reply")
    assert {r.line for r in lines.collect()} == {"- Knowledge of radar", "- Ability to run", "- Knowledge of maps"}
    have = frame(spark, [("a", 1, "Radar sets", "skill", 0.5, None), ("b", 2, "maps", "skill", 0.5, None)])
    assert {r.line for r in P.new_only(lines, have).collect()} == {"- Ability to run", "- Knowledge of maps"}
    tagged = spark.createDataFrame([("[Knowledge] of x.",), ("other",), ("- Ability to y",)], "line string")
    assert {(r.item_type, r.text) for r in P.parsed(tagged).collect()} == {("knowledge", "of x"), ("ability", "Ability to y")}


def test_existing_block_lists_every_item(spark):
    rows = [("a", i, f"item {i}", "skill" if i % 2 else "knowledge", 0.5, None) for i in range(1000)] + [("b", 5, "maps", "ability", 0.5, None)]
    got = {r.doc_code: r.existing for r in P.existing_block(frame(spark, rows).repartition(5)).collect()}
    assert got == {"a": "\n".join(f"- [{'Skill' if i % 2 else 'Knowledge'}] item {i}" for i in range(1000)), "b": "- [Ability] maps"}


def test_provider_fallback(spark):
    def fails(prompts):
        raise TimeoutError

    df = spark.createDataFrame([(1, "some long words here"), (2, "")], "i long, prompt string")
    got = {r.i: r for r in P.asked(df, "prompt", {"openai": fails, "gemini": P.stub}, "openai").collect()}
    assert got[1].provider == "gemini" and got[1].errors == ["openai:TimeoutError"] and got[1].reply.startswith("- Knowledge of some long")
    assert got[2].reply is None


def test_calls_and_runtime(spark):
    def told(prompts, call):
        return [f"{call.model} {call.temperature} {call.max_tokens} {call.key}" for _ in prompts]

    df = spark.createDataFrame([(1, "some words")], "i long, prompt string")
    call, runtime = P.Call(model="m", temperature=0.5, max_tokens=9), P.Runtime("Gemini ", {"gemini": "secret"})
    assert runtime.chosen("openai") == "gemini" and P.Runtime().chosen(" OFF ") == "" and "secret" not in repr(runtime) + repr(runtime.call("gemini"))
    assert P.asked(df, "prompt", {"gemini": told}, runtime.chosen("openai"), call=call, runtime=runtime).first().reply == "m 0.5 9 secret"


def test_extractor_rows_and_fallback(spark):
    def extractor(texts):
        if any("fail" in t for t in texts):
            raise ValueError
        return [None if t == "none" else [] if t == "empty" else [{"Taxonomy Skill": " ", "Skill": f" {t} ", "score": "0.0", "confidence": "x", "Skill Tag": float("nan")}, {"Raw Skill": ""}, {"Description": "d", "Correlation Coefficient": "0.9", "ESCO ID": " E1 "}] for t in texts]

    docs = spark.createDataFrame([(1, "good"), (2, "none"), (3, "empty"), (4, "fail"), (5, None)], "i long, t string").coalesce(1)
    got = {}
    for r in P.extracted(docs, "i", "t", extractor).collect():
        got.setdefault(r.i, []).append((r.text, r.confidence, r.source, r.esco_id))
    assert sorted(got[1]) == [("d", 0.9, "extractor", "E1"), ("good", 0.5, "extractor", None)]
    assert all({x[2] for x in got[i]} == {"fallback-generic"} for i in (2, 3, 4)) and 5 in got
    assert {r.source for r in P.extracted(docs, "i", "t", None).collect()} == {"fallback-generic"}


def test_switched_off_and_inferred(spark):
    docs = spark.createDataFrame([("a", "Radar Maintenance is taught.")], "doc_code string, text string")
    have = frame(spark, [("a", 1, "assess maps", "skill", 0.5, None)])
    assert {r.source for r in P.enhanced(docs, have, {"openai": P.stub}, "disabled").collect()} == {"llm-heuristic"}
    rows = [("a", i, f"skill number{i}", "skill", c, None) for i, c in enumerate([0.1, None, 0.9, 0.8, 0.7, 0.6])] + [("b", 1, "skill", "skill", 0.5, None)]
    known = spark.createDataFrame([("b",), ("b",)], "doc_code string")
    said = lambda prompts: ["- radar theory\n• x\n* map reading *" for _ in prompts]
    got = P.inferred(frame(spark, rows), known, {"openai": said}, "openai").collect()
    assert {(r.doc_code, r.text, r.confidence, r.source, r.evidence) for r in got} == {("a", t, 0.45, "skill_inferred", "Inferred from skills: skill number2, skill number3") for t in ("radar theory", "map reading")} and len(got[0].parents) == 5
    assert P.inferred(frame(spark, rows), known, {"openai": lambda p: ["none of it" for _ in p]}, "openai").count() == 0


def test_vectors_have_length_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", None, " "] * 20)], "i long, t string")

    def embed(texts):
        return [[3.0 * len(t), 4.0 * len(t)] for t in texts] if len(texts) <= 32 else 1 / 0

    got = {tuple(r.vector) for r in P.embedded(df, "t", embed).collect()}
    assert got == {(0.6, 0.8), (0.0, 0.0)}


def test_provider_gets_the_whole_text(spark, tmp_path, monkeypatch):
    from skein.plans import q_items

    monkeypatch.setattr(P, "stub", lambda prompts: [f"{len(p)} {p[-4:]}" for p in prompts])
    texts = ["radar sets " * 1000 + "tail", "radar sets " * 1000 + "ends"]
    spark.createDataFrame([(i, "1N0X1", t) for i, t in enumerate(texts)], "afsc_doc_id long, code string, raw_text string").write.parquet(str(tmp_path / "afsc_doc.parquet"))
    got = {r.afsc_doc_id: r.reply for r in q_items.x06_s12_provider_with_cache(spark, str(tmp_path)).collect()}
    assert got == {0: "11004 tail", 1: "11004 ends"}


def test_without_reply_mined_items_and_heuristics_stand_in(spark):
    def fails(prompts):
        raise TimeoutError

    text = "They analyze enemy radar signals daily. Radar Maintenance is taught."
    docs = spark.createDataFrame([("a", text), ("b", ""), ("c", text), ("d", None)], "doc_code string, text string")
    r = docs.withColumn("reply", F.when(F.col("doc_code") == "c", "said"))
    got = {x.doc_code: (x.reply, x.source) for x in P.or_mined(r, "text").collect()}
    generic = ("intelligence analysis\ndata processing", "fallback-generic")
    assert got == {"a": ("analyze enemy radar signals daily", "fallback-pattern"), "b": generic, "c": ("said", "provider"), "d": generic}
    have = [("a", 9, "Brief crews", "skill", 0.5, None), ("a", 3, "analyze signals", "skill", 0.5, None), ("a", 4, "assess maps", "skill", 0.5, None), ("c", 1, "maps", "knowledge", 0.5, None), ("c", 2, "sight", "ability", 0.5, None), ("c", 3, "assess maps", "skill", 0.5, None)]
    out = {(x.doc_code, x.item_type, x.text, x.confidence) for x in P.enhanced(docs, frame(spark, have), {"openai": fails}, "openai").collect()}
    know = {("a", "knowledge", f"Knowledge of {t}", 0.55) for t in ("They", "Radar Maintenance")}
    assert out == know | {("a", "ability", f"Ability to {t}", 0.55) for t in ("analyze signals", "assess maps")}


def test_lines_that_hold_or_are_held_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("ab c") for _ in range(rng.randint(0, 9)))
    lines = [(rng.choice(["d", "e", None]), i, rng.choice([text(), text(), "???", None])) for i in range(150)]
    have = [(rng.choice(["d", "e", "f", None]), i, rng.choice([text(), "..", None]), "skill", 0.5, None) for i in range(25)]
    form = lambda t: " ".join(t.lower().split(" ")) if t is not None else None
    squeezed = lambda t: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", form(t).strip()))
    items = {d: {squeezed(t) for x, _, t, *_ in have if x == d and t and squeezed(t)} for d in "def"}
    want = {i for d, i, t in lines if not (d and t is not None and any(e in squeezed(t) or squeezed(t) in e for e in items[d]))}
    for few in (0, 10**6):
        monkeypatch.setattr(P, "FEW", few)
        got = P.new_only(spark.createDataFrame(lines, "doc_code string, i long, line string"), frame(spark, have)).collect()
        assert {r.i for r in got} == want and len(got) == len(want)


def test_places_in_groups_and_description(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([1.0, 2.0, 3.5, None, float("nan")])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(5)
    got = {(r.g, r.i): r.place for r in I.numbered(df, ["g"], [F.col("i").desc()]).collect()}
    want = {(g, i): 1 + sum(1 for h, j, _ in rows if h == g and j > i) for g, i, _ in rows}
    assert got == want
    vs = sorted(v for _, _, v in rows if v is not None and v == v)
    out = {r.name: r for r in A.described(df.withColumn("w", F.lit(None).cast("double")), ["v", "w"]).collect()}
    assert (out["v"].n, out["v"].min, out["v"].max, out["w"].n, out["w"].q50) == (len(vs), 1.0, 3.5, 0, None)
    for q, x in ((0.25, out["v"].q25), (0.5, out["v"].q50), (0.75, out["v"].q75)):
        at = q * (len(vs) - 1)
        lo, hi = vs[int(at)], vs[min(len(vs) - 1, int(at) + 1)]
        assert abs(x - (lo + (hi - lo) * (at - int(at)))) < 1e-9


def test_sample_is_stable_and_capped(spark):
    df = spark.createDataFrame([("a" if i % 3 else "b", i) for i in range(60)], "s string, i long")
    one = sorted(map(tuple, A.hash_sample(df, "s", F.col("i"), 7).collect()))
    two = sorted(map(tuple, A.hash_sample(df.repartition(5), "s", F.col("i"), 7).collect()))
    assert one == two and len(one) == 14
