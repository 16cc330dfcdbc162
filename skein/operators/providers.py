"""The boundary to external models: prompts, replies, fallback, cache. A deterministic stub stands in for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import col, filled, strip
from skein.operators.clean import item_form
from skein.operators.extract import ABILITY_VERBS, with_heuristics, with_mined
from skein.operators.items import first_wins, top_rows
from skein.session import cut

#: A provider answers a batch of prompts, None where it fails; it may take a :class:`Call` beside them.
Provider = Callable[..., list[str | None]]
#: An extractor gives the rows it found in each text, by whatever column names it has; None where it fails.
Extractor = Callable[[list[str]], list[list[dict[str, str]] | None]]


@dataclass(frozen=True)
class Call:
    """How a model is called; the key is passed on and never shown."""

    model: str | None = None
    temperature: float = 0.1
    max_tokens: int = 512
    seed: int | None = 42
    key: str | None = field(default=None, repr=False)


@dataclass(frozen=True)
class Runtime:
    """What a run sets over the configured provider: another one, and keys by provider."""

    provider: str | None = None
    keys: dict[str, str] = field(default_factory=dict, repr=False)

    def chosen(self, configured: str) -> str:
        """The provider to ask, empty if it is switched off."""
        name = (self.provider if self.provider is not None else configured).strip().lower()
        return "" if name in OFF else name

    def call(self, name: str, call: Call = Call()) -> Call:
        return replace(call, key=self.keys.get(name, call.key))

# Names that switch the provider off; column names of extractors, the first filled one counts.
OFF = ("", "disabled", "off", "false", "0")
TEXT_COLUMNS = ("Taxonomy Skill", "Description", "Raw Skill", "Skill")
SCORE_COLUMNS = ("Correlation Coefficient", "score", "confidence")
ID_COLUMNS = ("Skill Tag", "ESCO ID", "esco_id")
SCORE = 0.5
# Confidence and lengths of inferred statements, explicit ones under which there are any, marks of lines, what a vector's text is told by.
INFERRED, INFER_UNDER, LINE_MARKS, LINE_LENGTHS, PASSAGE = 0.45, 2, " -•*", (5, 100), "passage: "
# How model families want a prompt.
TOLD = "You are a concise assistant.\n"
TEMPLATES = {
    "mistral": ("[INST] ", " [/INST]"), "zephyr": (f"<|system|>\n{TOLD}<|user|>\n", "\n<|assistant|>\n"),
    "llama": (f"<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n{TOLD}<|eot_id|><|start_header_id|>user<|end_header_id|>\n", "\n<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n"),
}
# What to try after a provider that gave nothing, and the hints on balance.
FALLBACK = {"openai": ("gemini",), "gemini": ("openai",)}
HINTS = {
    "none": "Generate a balanced mix of Knowledge and Ability items.", "no_knowledge": "Currently heavy on Abilities; prefer 3–4 Knowledge items.", "no_ability": "Currently heavy on Knowledge; prefer 3–4 Ability items.",
    "few_knowledge": "Prefer more Knowledge items to balance coverage.", "few_ability": "Prefer more Ability items to balance coverage.", "even": "Balance Knowledge and Ability items.",
}
PROMPT_TEXT, REPLY_LINE, NEW_ITEMS, CONFIDENCE = 5000, 120, 6, 0.70
STATEMENT = r"(?i)^\s*-\s*(Knowledge of|Ability to)\s.+$"
TRAIL = r"\s*[.;:,!?]\s*$"
#: Characters of the substrings by which texts that hold each other are found.
GRAM, RARE = 4, "[jqxzkvwbyfgp0-9]"
#: Pairs a text up to which all are compared, and texts up to which one side is broadcast for that (some 20 MB).
FEW, SMALL = 20, 200_000


def stub(prompts: list[str]) -> list[str | None]:
    """Two statements made of the prompt's first words; nothing for an empty prompt."""
    out: list[str | None] = []
    for p in prompts:
        words = [w for w in p.lower().split() if w.isalpha() and len(w) > 3][:4]
        out.append(f"- Knowledge of {' '.join(words[:2])}\n- Ability to {' '.join(words[2:])}" if len(words) == 4 else None)
    return out


def asked(df: DataFrame, prompt: str, providers: dict[str, Provider], first: str, reply: str = "reply", call: Call = Call(), runtime: Runtime = Runtime()) -> DataFrame:
    """``df`` with the reply of the first provider that answers, its name, and what failed before; batch by batch.

    Providers that take a second argument get ``call`` with the key that ``runtime`` has for them.
    """
    order = [first, *FALLBACK.get(first, ())]
    takes = {name: len(signature(p).parameters) > 1 for name, p in providers.items()}
    calls = {name: runtime.call(name, call) for name in providers}
    names = [c for c in df.columns if c not in (reply, "provider", "errors")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prompts = b.column(names.index(prompt)).to_pylist()
            replies: list[str | None] = [None] * len(prompts)
            by: list[str | None] = [None] * len(prompts)
            errors: list[list[str]] = [[] for _ in prompts]
            for name in order:
                open_ = [i for i, r in enumerate(replies) if not r and prompts[i]]
                if not open_ or name not in providers:
                    continue
                try:
                    some = [prompts[i] for i in open_]
                    got = providers[name](some, calls[name]) if takes[name] else providers[name](some)
                except Exception as e:  # noqa: BLE001 - a provider's failure is a value here
                    got = [None] * len(open_)
                    for i in open_:
                        errors[i].append(f"{name}:{type(e).__name__}")
                for i, r in zip(open_, got, strict=True):
                    replies[i], by[i] = r, name if r else by[i]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replies, pa.string()), pa.array(by, pa.string()), pa.array(errors, pa.list_(pa.string()))], names=[*names, reply, "provider", "errors"])

    schema = df.select(*names, F.lit("").cast("string").alias(reply), F.lit("").cast("string").alias("provider"), F.array(F.lit("")).alias("errors")).schema
    for f in schema.fields[-3:]:
        f.nullable = True
    return df.select(*names).mapInArrow(run, schema)


def balance_hint(n_knowledge: Column, n_ability: Column) -> Column:
    k, a = n_knowledge, n_ability
    h = {name: F.lit(text) for name, text in HINTS.items()}
    return F.when((k == 0) & (a == 0), h["none"]).when(k == 0, h["no_knowledge"]).when(a == 0, h["no_ability"]).when(k < 2, h["few_knowledge"]).when(a < 2, h["few_ability"]).otherwise(h["even"])


def chat_template(model: Column, prompt: Column) -> Column:
    """The prompt as the model's family wants it."""
    m, p = F.lower(F.trim(model)), F.trim(prompt)
    out = p
    for family, (before, after) in reversed(TEMPLATES.items()):
        out = F.when(m.contains(family), F.concat(F.lit(before), p, F.lit(after))).otherwise(out)
    return out


def existing_block(items: DataFrame) -> DataFrame:
    """Everything each document has already, one line an item in order: doc_code, existing. Lists are collected in part before the shuffle."""
    line = F.concat(F.lit("- ["), F.initcap("item_type"), F.lit("] "), "text")
    listed = items.groupBy("doc_code").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("x"))
    return listed.select("doc_code", F.array_join(F.col("x.line"), "\n").alias("existing"))


def prompt_of(text: Column, existing: Column, hint: Column) -> Column:
    return F.concat(F.lit("Text:\n"), F.left(strip(text), F.lit(PROMPT_TEXT)), F.lit("\n\nKnown items:\n"), F.coalesce(existing, F.lit("- (none)")), F.lit("\n\n"), hint)


def sanitized(replies: DataFrame, ident: str, reply: str) -> DataFrame:
    """Lines of a reply that are statements: ``ident``, ord, line. Prefixes are recased, one last mark dropped, long ones left out, the first of equal ones kept."""
    lines = replies.select(ident, F.posexplode(F.split(col(reply), r"\r\n|\r|\n")).alias("ord", "line")).withColumn("line", strip("line")).where(F.col("line").rlike(STATEMENT))
    line = F.regexp_replace("line", TRAIL, "")
    line = F.regexp_replace(line, r"(?i)^\s*-\s*knowledge of", "- Knowledge of")
    line = F.regexp_replace(line, r"(?i)^\s*-\s*ability to", "- Ability to")
    kept = lines.withColumn("line", line).where(F.length(strip(F.regexp_replace("line", r"^-\s", ""))) <= REPLY_LINE).withColumn("_k", F.lower("line"))
    return first_wins(kept, [ident, "_k"]).drop("_k")


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with item_type and text, from a tag in brackets or the statement's prefix; others are left out."""
    s = strip(F.regexp_replace(strip(line), r"^-", ""))
    tag = F.lower(F.regexp_extract(s, r"(?i)^\[(knowledge|ability)\]\s+", 1))
    body = F.regexp_replace(strip(F.when(tag != "", F.regexp_replace(s, r"(?i)^\[(knowledge|ability)\]\s+", "")).otherwise(s)), TRAIL, "")
    low = F.lower(body)
    kind = F.when(tag != "", tag).when(low.startswith("knowledge of "), F.lit("knowledge")).when(low.startswith("ability to "), F.lit("ability"))
    return lines.withColumns({"item_type": kind, "text": body}).where(F.col("item_type").isNotNull())


def _parts(c: Column, n: Column) -> Column:
    """Substrings of ``c`` of ``n`` characters, where it has so many."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def held_in(short: DataFrame, long: DataFrame, ident: str) -> DataFrame:
    """All pairs (``ident``, s, l) of texts s of ``short`` (``ident``, s) and l of ``long`` (``ident``, l) of one ``ident`` where l holds s.

    Each s asks with one substring of ``GRAM`` characters (all of it, if it is shorter), one with letters that are rare in
    words, and each l answers with all of its own. Where all pairs of the groups are few (``FEW`` a text, counted first),
    they are compared as they are. Empty texts are held by none.
    """
    short, long = short.where(F.length("s") > 0).distinct(), long.where(F.length("l") > 0).distinct()
    count = lambda df, name: df.groupBy(ident).agg(F.count(F.lit(1)).alias(name))
    facts = count(short, "a").join(count(long, "b"), ident, "full").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a").cast("double") * F.col("b")).alias("pairs")).first()
    if (facts["pairs"] or 0) <= FEW * ((facts["a"] or 0) + (facts["b"] or 0)):
        few = F.broadcast(short) if (facts["a"] or 0) <= SMALL else short
        return long.join(few, ident).where(F.contains("l", F.col("s"))).select(ident, "s", "l")
    sizes = [r[0] for r in short.select(F.least(F.length("s"), F.lit(GRAM)).alias("n")).distinct().collect()]  # GRAM at most
    rare = lambda g: F.length(F.regexp_replace(g, RARE, ""))
    own = F.transform(_parts(F.col("s"), F.least(F.length("s"), F.lit(GRAM))), lambda g: F.struct(rare(g).alias("n"), F.xxhash64(g).alias("h"), g.alias("g")))
    asks = short.select(ident, "s", F.array_min(own)["g"].alias("g"))
    answers = long.select(ident, "l", F.explode(F.array_distinct(F.concat(*[_parts(F.col("l"), F.lit(n)) for n in sizes]))).alias("g"))
    return asks.join(answers, [ident, "g"]).where(F.contains("l", F.col("s"))).select(ident, "s", "l")


def new_only(lines: DataFrame, items: DataFrame, ident: str = "doc_code", line: str = "line") -> DataFrame:
    """Lines that neither equal nor hold nor are held by an item of their document, as :func:`item_form` has both.

    Pairs come from :func:`held_in` both ways, so a document costs its meeting pairs and not lines times items. A line
    without any letter or digit is held by every item. Null lines and lines of a null document stay.
    """
    a = cut(lines.withColumn("_f", item_form(line)))
    b = cut(items.select(F.col(ident), item_form("text").alias("_e")).where(filled("_e").isNotNull()).distinct())
    f, e = a.select(ident, "_f").distinct(), b.select(ident, "_e")
    holds = held_in(e.withColumnRenamed("_e", "s"), f.withColumnRenamed("_f", "l"), ident).select(ident, F.col("l").alias("_f"))
    held = held_in(f.withColumnRenamed("_f", "s"), e.withColumnRenamed("_e", "l"), ident).select(ident, F.col("s").alias("_f"))
    none = f.where(F.col("_f") == "").join(e, ident, "left_semi")
    met = holds.unionByName(held).unionByName(none).distinct()
    return a.join(met, [ident, "_f"], "left_anti").select(*lines.columns)


def cache_key(prefix: str, code: Column, text: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), code, F.left(F.md5(F.left(text, F.lit(500))), F.lit(8)))


def with_cache(df: DataFrame, cache: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Replies from the cache (key, reply) or, for keys it lacks, from ``ask``; and the new rows for the cache."""
    missing = ask(df.join(cache.select(key), key, "left_anti"))
    fresh = missing.where(F.col("reply").isNotNull()).select(key, "reply")
    once = fresh.groupBy(key).agg(F.min("reply").alias("reply"))
    return df.join(cache.unionByName(once), key, "left"), once


def or_mined(replies: DataFrame, text: str, reply: str = "reply") -> DataFrame:
    """``replies`` with ``source``; where no provider answered, the reply is the lines mined from the text, as :func:`with_mined` has them."""
    none = filled(reply).isNull()
    df = with_mined(replies.withColumn("_t", F.when(none, F.coalesce(text, F.lit(""))).otherwise("")), "_t")
    return df.withColumns({reply: F.when(none, F.array_join("mined.text", "\n")).otherwise(col(reply)), "source": F.when(none, F.col("mined")[0]["source"]).otherwise("provider")}).drop("_t", "mined")


def normalised(rows: DataFrame, ident: str, found: str) -> DataFrame:
    """Items of extractor rows (``found``: array of maps by column name): ``ident``, ord, text, confidence, esco_id.

    The first filled of the known text, score and id columns counts; a blank text drops the row, a score that is missing,
    0, NaN or no number is ``SCORE``, a blank or NaN id none.
    """
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.col("_r")[n]), F.lit("")) for n in names], F.lit(None).cast("string"))
    number = lambda n: F.col("_r")[n].try_cast("double")
    given = [F.when(filled(F.trim(F.col("_r")[n])).isNotNull() & (F.coalesce(number(n), F.lit(1.0)) != 0) & ~F.isnan(F.coalesce(number(n), F.lit(1.0))), F.struct(number(n).alias("v"))) for n in SCORE_COLUMNS]
    score = F.coalesce(F.coalesce(*given)["v"], F.lit(SCORE))
    out = rows.select(ident, F.posexplode(found).alias("ord", "_r")).select(ident, F.col("ord").cast("long").alias("ord"), first(TEXT_COLUMNS).alias("text"), score.alias("confidence"), F.when(F.lower(first(ID_COLUMNS)) != "nan", first(ID_COLUMNS)).alias("esco_id"))
    return out.where(F.col("text").isNotNull())


def extracted(docs: DataFrame, ident: str, text: str, extractor: Extractor | None, most: int = 6) -> DataFrame:
    """Items of each document: ``ident`` (unique), ord, text, confidence, source, esco_id.

    By the extractor, put whole texts in batches; where there is none, or it fails on a text, gives nothing or nothing
    usable, by the phrases mined from the text (:func:`with_mined`). A batch that fails is put text by text.
    """
    docs = docs.select(ident, F.coalesce(text, F.lit("")).alias("_text"))
    none = F.lit(None).cast("string")
    if extractor is None:
        return with_mined(docs, "_text", most).select(ident, F.inline("mined")).withColumn("esco_id", none)

    def one(texts: list[str]) -> list[list[dict[str, str]] | None]:
        try:
            return list(extractor(texts))
        except Exception:  # noqa: BLE001 - an extractor's failure is a missing result here
            return [None] if len(texts) == 1 else [one([t])[0] for t in texts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.map_(pa.string(), pa.string()))
        for b in batches:
            got = one(b.column(1).to_pylist()) if b.num_rows else []
            rows = [None if r is None else [[(str(k), None if v is None else str(v)) for k, v in x.items()] for x in r] for r in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], names=[ident, "_text", "_found"])

    found = cut(docs.mapInArrow(run, f"{ident} {docs.schema[ident].dataType.simpleString()}, _text string, _found array<map<string,string>>"))
    items = normalised(found, ident, "_found").withColumn("source", F.lit("extractor"))
    rest = found.select(ident, "_text").join(items.select(ident).distinct(), ident, "left_anti")
    return items.select(ident, "ord", "text", "confidence", "source", "esco_id").unionByName(with_mined(rest, "_text", most).select(ident, F.inline("mined")).withColumn("esco_id", none))


def inferred(items: DataFrame, explicit: DataFrame, providers: dict[str, Provider], first: str) -> DataFrame:
    """Knowledge inferred from skills: doc_code, text, item_type, confidence, source, evidence, parents.

    For documents with skills and fewer than ``INFER_UNDER`` rows in ``explicit`` (doc_code): the five surest skills are put
    to a provider; lines of sound length of a reply that doesn't say NONE are statements, which come from these skills.
    """
    skills = items.where(F.col("item_type") == "skill").select("doc_code", "ord", "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    five = top_rows(skills, ["doc_code"], [F.col("confidence").desc(), F.col("ord")], 5).groupBy("doc_code").agg(F.array_sort(F.collect_list(F.struct("rank_no", "text"))).alias("x")).select("doc_code", F.col("x.text").alias("parents"))
    enough = explicit.groupBy("doc_code").count().where(F.col("count") >= INFER_UNDER)
    prompt = F.concat(F.lit("Skills:\n- "), F.array_join("parents", "\n- "))
    replies = asked(five.join(enough, "doc_code", "left_anti").select("doc_code", "parents", prompt.alias("prompt")), "prompt", providers, first)
    lines = replies.where(F.col("reply").isNotNull() & ~F.upper("reply").contains("NONE")).select("doc_code", "parents", F.explode(F.split(F.trim("reply"), "\n")).alias("l")).withColumn("text", F.trim(F.btrim("l", F.lit(LINE_MARKS))))
    good = lines.where((F.length("text") > LINE_LENGTHS[0]) & (F.length("text") < LINE_LENGTHS[1]))
    return good.select("doc_code", "text", F.lit("knowledge").alias("item_type"), F.lit(INFERRED).alias("confidence"), F.lit("skill_inferred").alias("source"), F.concat(F.lit("Inferred from skills: "), F.array_join(F.slice("parents", 1, 2), ", ")).alias("evidence"), "parents")


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], vector: str = "vector", batch: int = 32) -> DataFrame:
    """``df`` with the vector of each text, of length 1, by an external ``embed``; texts that aren't blank are told as passages.

    Null counts as empty; a vector of no length stays as it is.
    """
    names = [c for c in df.columns if c != vector]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [PASSAGE + t if t and t.strip() else "" for t in b.column(names.index(text)).to_pylist()]
            got = [v for at in range(0, len(told), batch) for v in embed(told[at : at + batch])]
            sizes = [sum(x * x for x in v) ** 0.5 or 1.0 for v in got]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[x / n for x in v] for v, n in zip(got, sizes, strict=True)], pa.list_(pa.float64()))], names=[*names, vector])

    schema = df.select(*names, F.array(F.lit(0.0)).alias(vector)).schema
    return df.select(*names).mapInArrow(run, schema)


def enhanced(docs: DataFrame, items: DataFrame, providers: dict[str, Provider], first: str) -> DataFrame:
    """New items of ``docs`` (doc_code, text): doc_code, item_type, text, confidence, source.

    Of each reply the first new lines; where no provider answered, or ``first`` is switched off (:meth:`Runtime.chosen`),
    abilities from the first two skills with a fitting verb if the document has none, and knowledge from its first three
    topics likewise. Each prompt is put once: replies are cut.
    """
    first = Runtime().chosen(first)
    if not first:
        providers = {}
    n = lambda k: F.count_if(F.col("item_type") == k)
    fits = (F.col("item_type") == "skill") & F.lower(F.split("text", " ")[0]).isin(*ABILITY_VERBS)
    fit = F.slice(F.array_sort(F.collect_list(F.when(fits, F.struct("ord", "text")))), 1, 2)
    facts = items.groupBy("doc_code").agg(balance_hint(n("knowledge"), n("ability")).alias("hint"), (n("knowledge") > 0).alias("has_k"), F.when(n("ability") == 0, fit).alias("fit"))
    known = docs.join(existing_block(items), "doc_code", "left").join(facts, "doc_code", "left")
    prompt = prompt_of(F.coalesce("text", F.lit("")), F.col("existing"), F.coalesce("hint", F.lit(HINTS["none"])))
    none = filled("reply").isNull()
    kept = [F.when(none, F.coalesce("text", F.lit(""))).alias("text"), F.when(none, F.col("fit")).alias("fit"), "has_k"]
    replies = cut(asked(known.select("doc_code", "text", "has_k", "fit", prompt.alias("prompt")), "prompt", providers, first).select("doc_code", "reply", "provider", *kept))
    new = top_rows(parsed(new_only(sanitized(replies, "doc_code", "reply"), items)), ["doc_code"], [F.col("ord")], NEW_ITEMS)
    new = new.join(replies.select(F.col("doc_code").alias("_d"), "provider"), F.col("doc_code").eqNullSafe(F.col("_d"))).select("doc_code", "item_type", "text", F.lit(CONFIDENCE).alias("confidence"), F.concat(F.lit("llm-"), "provider").alias("source"))
    failed = with_heuristics(replies.where(none).withColumn("mined", F.coalesce("fit", F.array().cast(replies.schema["fit"].dataType))), "text")
    more = F.filter("more", lambda x: (x["item_type"] == "ability") | ~F.coalesce("has_k", F.lit(False)))
    return new.unionByName(failed.select("doc_code", F.inline(more)).select("doc_code", "item_type", "text", "confidence", "source"))
