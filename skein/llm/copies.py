"""Records that differ only in formatting or field order, collapsed and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut

#: Fixed names of the fields a text may hold.
FIELDS = ("action", "object", "setting", "level")
#: Of these all must be present for a text to count as fields.
NEEDED = ("action", "object", "setting")


def letters(c: Column) -> Column:
    """Letters (with their marks) and digits of ``c`` in order, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}]+", ""))


def blank(c: Column) -> Column:
    """True for null and for texts without anything but white space and invisible characters."""
    return F.coalesce(F.regexp_replace(c, r"(?U)[\s\p{Cf}]+", "") == "", F.lit(True))


def canonical_fields(c: Column) -> Column:
    """The canonical form of a text that is a phrase or named fields.

    A phrase is its letters; named fields are ``field=letters`` sorted by field. Any notation counts whose field names
    are followed by ``:`` or ``=`` (quotes between allowed).
    """
    low = F.lower(F.regexp_replace(c, r"\p{Cf}+", ""))
    mark = rf"(?U)[^\p{{L}}\p{{N}}]*\b({'|'.join(FIELDS)})[\"'“”\s]*[:=]"
    marked = F.regexp_replace(low, mark, "\u0001$1\u0002")
    pairs = F.transform(
        F.filter(F.split(marked, "\u0001"), lambda x: F.contains(x, F.lit("\u0002"))),
        lambda x: F.concat(F.substring_index(x, "\u0002", 1), F.lit("="), letters(F.substring_index(x, "\u0002", -1))),
    )
    lead = letters(F.substring_index(marked, "\u0001", 1))
    named = F.lit(True)
    for k in NEEDED:
        named &= F.contains(marked, F.lit(f"\u0001{k}\u0002"))
    return F.when(named, F.concat(lead, F.lit("\u0001"), F.array_join(F.array_sort(pairs), "\u0001"))).otherwise(letters(low))


def canonical_map(c: Column) -> Column:
    """A map's entries as ``key=letters`` sorted by key; null stays null."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(letters(e["key"]), F.lit("="), F.coalesce(letters(e["value"]), F.lit("\u0000"))))), "\u0001")


def fingerprint(*parts: Column) -> Column:
    """128 bits over the parts, of which null and empty differ. Two different records among 10^10 meet with p < 10^-18."""
    return F.unhex(F.md5(F.concat_ws("\u0003", *[F.coalesce(F.concat(F.lit("\u0004"), p), F.lit("\u0005")) for p in parts])))


def hot_keys(keyed: DataFrame, key: str, share: float, bins: int = 1 << 14) -> DataFrame | None:
    """Exactly the keys that hold at least ``share`` of the rows (two or more), as a table of at most ``1 / share`` rows; None if there is none.

    Partial counts by a hash of the key (``bins`` of them, added up inside each task before the shuffle) leave few bins
    that can hold a hot key; only their rows are counted by key.
    """
    bin_of = F.pmod(F.xxhash64(key), F.lit(bins))
    binned = keyed.groupBy(bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_n")).collect()  # at most ``bins`` rows
    least = max(2.0, share * sum(x["_n"] for x in binned))
    bins_hot = [x["_bin"] for x in binned if x["_n"] >= least]
    if not bins_hot:
        return None
    hot = cut(keyed.where(bin_of.isin(bins_hot)).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key))
    return None if hot.isEmpty() else hot


def collapse(keyed: DataFrame, key: str, ident: str, share: float = 0.001, salts: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each ``key``: the smallest ``ident`` as ``keep_id``, the number of rows as ``n_copies``, and ``keep``.

    Hot keys (see :func:`hot_keys`) are salted into a first level and added up in a second; all others need the first
    shuffle only. Both levels carry partial sums. Null keys are no key and left out; rows with a null ``ident`` count
    but are never kept as ``keep_id`` unless the whole set has none. Columns ``keep`` are the same in all rows of a key.
    Keys are read several times: they are kept once, as small rows.
    """
    rows = cut(keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(ident).alias("_id"), *keep))
    hot = hot_keys(rows, "_key", share)

    def level(df: DataFrame, *by: str, first: bool) -> DataFrame:
        count = F.count(F.lit(1)) if first else F.sum("n_copies")
        return df.groupBy(*by, *keep).agg(F.min("_id" if first else "keep_id").alias("keep_id"), count.alias("n_copies"))

    if hot is None:
        return level(rows, "_key", first=True).drop("_key")
    hot = F.broadcast(hot)  # 1 / share keys at most
    cold = level(rows.join(hot, "_key", "left_anti"), "_key", first=True)
    salted = level(rows.join(hot, "_key", "left_semi").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts))), "_key", "_salt", first=True)
    return cold.drop("_key").unionByName(level(salted, "_key", first=False).drop("_key"))


def item_keys(items: DataFrame) -> DataFrame:
    """``id`` and ``key`` of the ksa_item records with a non-blank name; copies have equal keys.

    Null code, type or meta equal each other and nothing else; names are compared by letters and digits, ``meta`` by its
    keys and values in any order.
    """
    return items.where(~blank(F.col("name"))).select(F.col("item_id").alias("id"), fingerprint(F.col("afsc_code"), F.col("type"), letters(F.col("name")), canonical_map(F.col("meta"))).alias("key"))


def candidate_keys(candidates: DataFrame) -> DataFrame:
    """``id`` and ``key`` of the candidates with a non-blank text; copies have equal keys."""
    return candidates.where(~blank(F.col("text_norm"))).select(F.col("candidate_id").alias("id"), fingerprint(F.col("afsc"), F.col("label"), F.col("source_doc"), canonical_fields(F.col("text_norm"))).alias("key"))


def copy_sets(items: DataFrame, candidates: DataFrame, **how) -> DataFrame:
    """One row for each set of two or more copies of either table: src, keep_id, n_copies. Both tables are collapsed in one."""
    of = lambda df, src: df.select("id", F.concat(F.lit(src[4:5].encode()), "key").alias("key"), F.lit(src).alias("src"))
    keyed = of(item_keys(items), "ksa_item").unionByName(of(candidate_keys(candidates), "ksa_candidates_v0_raw"))
    return collapse(keyed, "key", "id", keep=("src",), **how).select("src", "keep_id", "n_copies").where(F.col("n_copies") > 1)
