"""Queries over texts: cleaning, extraction, evidence, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import clean, extract
from skein.operators.items import items_of
from skein.operators.stats import count_types
from skein.plans import sql as S
from skein.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "afsc_doc").where(F.col("raw_text").isNotNull())


RAW = "FROM afsc_doc WHERE raw_text IS NOT NULL"
LINES = "string_split(raw_text, chr(10))"
BLANK = f"regexp_replace(x, '{S.WS}+', '', 'g') = ''"
INDENT = f"coalesce(list_min(list_transform(list_filter({LINES}, lambda x: regexp_replace(x, '{S.WS}+', '', 'g') <> ''), lambda x: length(regexp_extract(x, '^[ \\t]*', 0)))), 0)"
DEDENT = S.strip(f"array_to_string(list_transform({LINES}, lambda x: CASE WHEN {BLANK} THEN '' ELSE substr(x, CAST({INDENT} AS BIGINT) + 1) END), chr(10))")


@query(f"SELECT afsc_doc_id, {DEDENT} AS text {RAW}")
def c01_dedent(spark, d):
    return _docs(spark, d).select("afsc_doc_id", clean.dedent("raw_text").alias("text"))


FENCES = r"(?s)```.+?```"
ROWS = rf"(?m)^({S.WS}*\|.*\|){S.WS}*$"
NUMBERS = rf"(?m)^{S.WS}*\p{{Nd}}{{1,4}}{S.WS}*$"
HEADS = rf"(?im)^{S.WS}*(DAFECD|AFECD|AFI|AFMAN|USSF).*$"
NOTES = rf"(?im)^{S.WS}*NOTE:.*$"


@query(f"SELECT afsc_doc_id, {S.sub('raw_text', FENCES, ' ')} AS fences, {S.sub('raw_text', ROWS, ' ')} AS table_rows {RAW}")
def c02_c03_fences_and_rows(spark, d):
    return _docs(spark, d).select("afsc_doc_id", clean.drop_fences("raw_text").alias("fences"), clean.drop_table_rows("raw_text").alias("table_rows"))


@query(f"SELECT afsc_doc_id, {S.sub('raw_text', NUMBERS, ' ')} AS numbers, {S.sub('raw_text', HEADS, ' ')} AS heads, {S.sub('raw_text', NOTES, ' ')} AS notes {RAW}")
def c04_c06_drop_lines(spark, d):
    return _docs(spark, d).select("afsc_doc_id", clean.drop_page_numbers("raw_text").alias("numbers"), clean.drop_headers("raw_text").alias("heads"), clean.drop_notes("raw_text").alias("notes"))


WRAPS = rf"({S.WORD})-\n({S.WORD})"


@query(f"SELECT afsc_doc_id, replace({S.sub('raw_text', WRAPS, chr(92) + '1' + chr(92) + '2')}, chr(13), chr(10)) AS text {RAW}")
def c07_c08_join_wraps(spark, d):
    return _docs(spark, d).select("afsc_doc_id", F.translate(clean.join_wraps("raw_text"), "\r", "\n").alias("text"))


_chain = DEDENT
for _p, _put in ((FENCES, " "), (ROWS, " "), (NUMBERS, " "), (HEADS, " "), (NOTES, " "), (WRAPS, r"\1\2")):
    _chain = S.sub(_chain, _p, _put)
CLEAN = S.squeeze(f"replace({_chain}, chr(13), chr(10))")


@query(f"SELECT afsc_doc_id, {CLEAN} AS text {RAW}")
def c09_clean_text(spark, d):
    return _docs(spark, d).select("afsc_doc_id", clean.clean_text("raw_text").alias("text"))


_pdf = "replace(raw_text, chr(13), chr(10))"
for _p, _put in (
    (r"[ \t]+\n", "' || chr(10) || '"), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (rf"(?m)^(DAF?E?CD.*|Page{S.WS}+\p{{Nd}}+){S.WS}*$", ""), (f"[{clean.BULLETS}]", "* "), (rf"({S.WORD}){S.WS}*-{S.WS}*({S.WORD})", r"\1-\2"),
    (rf"({S.WORD}){S.WS}{{2,}}({S.WORD})", r"\1 \2"), (rf"({S.WORD}){S.WS}+([.,;:])", r"\1\2"), ("’", "''"), ("[“”]", '"'), (r"[ \t]{2,}", " "),
):
    _pdf = S.sub(_pdf, _p, _put)


@query(f"SELECT afsc_doc_id, {S.strip(_pdf)} AS text {RAW}")
def c10_repair_page_text(spark, d):
    return _docs(spark, d).select("afsc_doc_id", clean.repair_page_text("raw_text").alias("text"))


@query(f"SELECT afsc_doc_id, replace(regexp_replace(raw_text, '[ \\t]+\\n', chr(10), 'g'), chr(173), '') AS text {RAW}")
def c11_page_cleanup(spark, d):
    return _docs(spark, d).select("afsc_doc_id", clean.page_cleanup("raw_text").alias("text"))


@query(f"SELECT doc_id, {S.squeeze("coalesce(text, '')")} AS text FROM documents")
def c12_squeezed(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squeeze(F.coalesce("text", F.lit(""))).alias("text"))


_know = "evidence"
for _p, _put, _f in ((r"^(Based on.*?:|Quote:\s*|Here are.*?:|\d+\.\s*)", "", ""), (r"\*\*([^*]+)\*\*", r"\1", "g"), (r'^"([^"]+)"', r"\1", ""), (r"\s*-\s*Exact quote:.*", "", "g")):
    _know = f"regexp_replace({_know}, '{_p}', '{_put}'{f", '{_f}'" if _f else ''})"


@query(f"""WITH k AS (SELECT candidate_id, {_know} AS s FROM ksa_candidates_v0_raw WHERE evidence IS NOT NULL)
    SELECT candidate_id, {S.strip(f"CASE WHEN regexp_extract(s, 'Knowledge is mandatory of[:\\s]+([^.]+)', 1) <> '' THEN regexp_extract(s, 'Knowledge is mandatory of[:\\s]+([^.]+)', 1) ELSE s END")} AS text FROM k""")
def c13_knowledge_text(spark, d):
    return table(spark, d, "ksa_candidates_v0_raw").where(F.col("evidence").isNotNull()).select("candidate_id", clean.knowledge_text("evidence").alias("text"))


def _canon(x: str) -> str:
    ends = clean.ENDS.replace("'", "''")
    return f"trim(lower({S.squeeze(f"coalesce({x}, '')")}), '{ends}')"


CANON_MAP = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clean.CANONICAL.items()) + " ELSE t END"


@query(f"SELECT item_id, {CANON_MAP} AS text FROM (SELECT item_id, {_canon('name')} AS t FROM ksa_item)")
def c15_canonical_item(spark, d):
    return table(spark, d, "ksa_item").select("item_id", clean.canonical_item("name").alias("text"))


@query(f"SELECT item_id, {S.match_form('name')} AS form FROM ksa_item")
def c16_match_form(spark, d):
    return table(spark, d, "ksa_item").select("item_id", T.match_form("name").alias("form"))


_form = f"lower({S.strip('name')})"
for _p, _put in ((rf"^-{S.WS}*\[(knowledge|ability)\]{S.WS}*", ""), (rf"^-{S.WS}*(knowledge of|ability to){S.WS}*", ""), (r"[^a-z0-9\t\n\x0b\f\r \x{85}\p{Z}]", ""), (f"{S.WS}+", " ")):
    _form = S.sub(_form, _p, _put)


@query(f"SELECT item_id, {_form} AS form FROM ksa_item WHERE name IS NOT NULL")
def c17_item_form(spark, d):
    return table(spark, d, "ksa_item").where(F.col("name").isNotNull()).select("item_id", clean.item_form("name").alias("form"))


@query(r"""SELECT item_id, CASE type WHEN 'knowledge' THEN regexp_replace(name, '(?i)^\s*knowledge of\s+', '') WHEN 'ability' THEN regexp_replace(name, '(?i)^\s*ability to\s+', '') ELSE name END AS text
    FROM ksa_item WHERE name IS NOT NULL""")
def c18_without_prefix(spark, d):
    return table(spark, d, "ksa_item").where(F.col("name").isNotNull()).select("item_id", clean.without_prefix("name", "type").alias("text"))


@query(f"SELECT item_id, lower({S.strip('name')}) AS key, lower({S.squeeze('name')}) AS loose_key FROM ksa_item WHERE name IS NOT NULL")
def c19_keys(spark, d):
    return table(spark, d, "ksa_item").where(F.col("name").isNotNull()).select("item_id", F.lower(T.strip("name")).alias("key"), F.lower(T.squeeze("name")).alias("loose_key"))


@query("SELECT item_id, type || '_' || left(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), 50) AS slug FROM ksa_item WHERE name IS NOT NULL AND type IS NOT NULL")
def c20_slug(spark, d):
    return table(spark, d, "ksa_item").where(F.col("name").isNotNull() & F.col("type").isNotNull()).select("item_id", T.slug(F.col("type"), "name").alias("slug"))


# extraction, over clean texts where there are any
DOCS = "docs AS (SELECT afsc_doc_id, coalesce(clean_text, raw_text, '') AS text FROM afsc_doc)"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "afsc_doc").select("afsc_doc_id", F.coalesce("clean_text", "raw_text", F.lit("")).alias("text"))


VERB_ROWS = ", ".join(f"({i}, '{v}')" for i, v in enumerate(extract.VERBS))
VERB_SQL = rf"""{DOCS}, shaped AS (SELECT afsc_doc_id, {S.shape('text')} AS s FROM docs), verbs(vord, verb) AS (VALUES {VERB_ROWS}),
  hits AS (SELECT afsc_doc_id, vord, verb, unnest(regexp_extract_all(s, '\b' || verb || '(?:s|es|ing)?\s+([a-z]+\s+[a-z]+(?:\s+[a-z]+){{0,2}})\b', 1)) AS object,
             generate_subscripts(regexp_extract_all(s, '\b' || verb || '(?:s|es|ing)?\s+([a-z]+\s+[a-z]+(?:\s+[a-z]+){{0,2}})\b', 1), 1) - 1 AS pos FROM shaped, verbs),
  good AS (SELECT *, row_number() OVER (PARTITION BY afsc_doc_id ORDER BY vord, pos) AS n FROM hits WHERE length(trim(object)) > 15 AND NOT regexp_matches(object, 'and the|or the|of the|to the')),
  verb_items AS (SELECT afsc_doc_id, CAST(vord AS INTEGER) AS vord, CAST(pos AS INTEGER) AS pos, regexp_replace(verb || ' ' || object, '\s+(and|or|the|for|with|from)$', '') AS phrase FROM good WHERE n <= 8)"""


@query(f"WITH {VERB_SQL} SELECT * FROM verb_items")
def x01_verb_phrases(spark, d):
    return extract.verb_phrases(_texts(spark, d), "afsc_doc_id", "text")


DOMAIN_ROWS = ", ".join(f"({i}, '{w}')" for i, w in enumerate(extract.DOMAIN_WORDS))
DOMAIN_SQL = rf"""domain(word_no, word) AS (VALUES {DOMAIN_ROWS}),
  around AS (SELECT afsc_doc_id, word_no, trim(regexp_extract(s, '\b([a-z]+\s+)' || word || '(\s+[a-z]+)?\b', 1) || regexp_extract(s, '\b([a-z]+\s+)' || word || '(\s+[a-z]+)?\b', 2)) AS phrase FROM shaped, domain),
  domain_items AS (SELECT afsc_doc_id, CAST(word_no AS INTEGER) AS word_no, phrase FROM around WHERE length(phrase) BETWEEN 15 AND 60 AND NOT contains(phrase, '  '))"""


@query(f"WITH {VERB_SQL}, {DOMAIN_SQL} SELECT * FROM domain_items")
def x02_domain_phrases(spark, d):
    return extract.domain_phrases(_texts(spark, d), "afsc_doc_id", "text")


MINED_SQL = f"""{VERB_SQL}, {DOMAIN_SQL},
  enough AS (SELECT afsc_doc_id FROM verb_items GROUP BY 1 HAVING count(*) >= 4),
  every AS (SELECT afsc_doc_id, vord * 1000 + pos AS ord, phrase AS text, 0.55 AS confidence, 'fallback-pattern' AS source FROM verb_items
    UNION ALL SELECT afsc_doc_id, 100000 + word_no, phrase, 0.5, 'fallback-domain' FROM domain_items WHERE afsc_doc_id NOT IN (SELECT afsc_doc_id FROM enough)),
  uniq AS (SELECT *, row_number() OVER (PARTITION BY afsc_doc_id, lower(trim(text)) ORDER BY ord) AS k FROM every WHERE length(trim(text)) > 8),
  six AS (SELECT *, row_number() OVER (PARTITION BY afsc_doc_id ORDER BY ord) AS n FROM uniq WHERE k = 1),
  mined AS (SELECT afsc_doc_id, ord, text, CAST(confidence AS DOUBLE) AS confidence, source FROM six WHERE n <= 6
    UNION ALL SELECT afsc_doc_id, 200000 + i, t, 0.3, 'fallback-generic' FROM (SELECT DISTINCT afsc_doc_id FROM docs), (VALUES (0, 'intelligence analysis'), (1, 'data processing')) AS g(i, t) WHERE afsc_doc_id NOT IN (SELECT afsc_doc_id FROM six WHERE n <= 6))"""


@query(f"WITH {MINED_SQL} SELECT afsc_doc_id, CAST(ord AS INTEGER) AS ord, text, confidence, source, 'skill' AS item_type FROM mined")
def x03_x04_mined_items(spark, d):
    return extract.mined_items(_texts(spark, d), "afsc_doc_id", "text")


def of_cleaned(ctes: str) -> str:
    """CTEs over the cleaned raw texts instead of the clean ones."""
    return ctes.replace("coalesce(clean_text, raw_text, '')", CLEAN.replace("raw_text", "coalesce(raw_text, '')"))


#: The stand-in model's two lines from the first four longer words of a prompt; null for fewer.
def stub_sql(prompt: str) -> str:
    words = rf"list_filter(regexp_split_to_array(lower({prompt}), '{S.WS}+'), lambda x: regexp_full_match(x, '\p{{L}}+') AND length(x) > 3)[1:4]"
    return f"CASE WHEN len({words}) = 4 THEN '- Knowledge of ' || ({words})[1] || ' ' || ({words})[2] || chr(10) || '- Ability to ' || ({words})[3] || ' ' || ({words})[4] END"


@query(f"""WITH {of_cleaned(MINED_SQL)}
  SELECT afsc_doc_id, count(*) AS total, count(*) FILTER (false) AS knowledge, count(*) AS skills, count(*) FILTER (false) AS abilities FROM mined GROUP BY 1""")
def a04_items_per_document(spark, d):
    """Flagship: every document cleaned, mined and counted."""
    docs = T.computed(table(spark, d, "afsc_doc").select("afsc_doc_id", "raw_text"), text=clean.clean_text("raw_text")).drop("raw_text")
    items = extract.mined_items(docs, "afsc_doc_id", "text").withColumn("esco_id", F.lit(None).cast("string"))
    return count_types(items, "afsc_doc_id").drop("aligned")


@query(f"""WITH {DOCS}, low AS (SELECT afsc_doc_id, lower(text) AS s FROM docs),
  f AS (SELECT afsc_doc_id, 'knowledge of intelligence cycle' AS text, 'knowledge' AS item_type, 0.2 AS confidence FROM low WHERE contains(s, 'knowledge')
    UNION ALL SELECT afsc_doc_id, 'imagery exploitation', 'skill', 0.2 FROM low WHERE contains(s, 'skill')
    UNION ALL SELECT afsc_doc_id, 'brief intelligence findings', 'ability', 0.2 FROM low WHERE contains(s, 'abilit'))
  SELECT afsc_doc_id, text, item_type, CAST(confidence AS DOUBLE) AS confidence FROM f
  UNION ALL SELECT afsc_doc_id, 'general geospatial intelligence competence', 'skill', 0.1 FROM low WHERE NOT (contains(s, 'knowledge') OR contains(s, 'skill') OR contains(s, 'abilit'))""")
def x05_last_resort(spark, d):
    return extract.last_resort_items(_texts(spark, d), "afsc_doc_id", "text")


_topic = r"regexp_replace(regexp_replace(regexp_replace(text, '[\x{85}\p{Z}]', ' ', 'g'), '[^\x00-\x7F\p{L}\p{M}\p{N}]', '#', 'g'), '[^\x00-\x7F]', '_', 'g')"
TOPIC_SQL = rf"""{DOCS}, t AS (SELECT afsc_doc_id, {_topic} AS s FROM docs),
  l AS (SELECT afsc_doc_id, list_concat(regexp_extract_all(s, '\b([A-Z][a-zA-Z0-9/\-+]+(?:\s+[A-Z][a-zA-Z0-9/\-+]+){{0,3}})\b', 1), regexp_extract_all(s, '(?i)\b([A-Za-z0-9/\-+]+\s+(?:{extract.TOPIC_NOUNS}))\b', 1)) AS x FROM t),
  e AS (SELECT afsc_doc_id, unnest(x) AS topic, generate_subscripts(x, 1) - 1 AS ord FROM l),
  u AS (SELECT *, row_number() OVER (PARTITION BY afsc_doc_id, lower(trim(topic)) ORDER BY ord) AS k FROM e WHERE length(trim(topic)) > 3),
  topics AS (SELECT *, row_number() OVER (PARTITION BY afsc_doc_id ORDER BY ord) AS n FROM u WHERE k = 1)"""


@query(f"WITH {TOPIC_SQL} SELECT afsc_doc_id, CAST(ord AS INTEGER) AS ord, topic FROM topics WHERE n <= 8")
def x09_topics(spark, d):
    return extract.topics(_texts(spark, d), "afsc_doc_id", "text")


HEURISTIC_SQL = f"""{MINED_SQL}, {TOPIC_SQL[TOPIC_SQL.index(', t AS') + 2:]},
  fit AS (SELECT afsc_doc_id, text, row_number() OVER (PARTITION BY afsc_doc_id ORDER BY ord) AS n FROM mined WHERE lower(split_part(text, ' ', 1)) IN ({', '.join(f"'{v}'" for v in extract.ABILITY_VERBS)}))"""


@query(f"""WITH {HEURISTIC_SQL} SELECT afsc_doc_id, 'Ability to ' || lower(left(text, 1)) || substr(text, 2) AS text, 'ability' AS item_type, 0.55::DOUBLE AS confidence, 'llm-heuristic' AS source FROM fit WHERE n <= 2
  UNION ALL SELECT afsc_doc_id, 'Knowledge of ' || topic, 'knowledge', 0.55, 'llm-heuristic' FROM topics WHERE n <= 3""")
def x10_x11_heuristic_items(spark, d):
    docs = _texts(spark, d)
    return extract.heuristic_items(docs, extract.mined_items(docs, "afsc_doc_id", "text"), "afsc_doc_id", "text")


def _section_sql(no: int, ends: str, opens: str) -> str:
    """Passages after ``opens`` up to what ``ends``, before which a mark is put, or up to the text's end."""
    marked = rf"regexp_replace(regexp_replace(text, '\n$', ''), '({ends})', chr(1) || '\1', 'g')"
    return rf"""SELECT afsc_doc_id, {no} AS pattern_no, CAST(k - 1 AS INTEGER) AS pos, h[k] AS hit FROM (SELECT afsc_doc_id, h, unnest(range(1, len(h) + 1)) AS k FROM
      (SELECT afsc_doc_id, regexp_extract_all({marked}, '(?is){opens}([^\x01]+)', 1) AS h FROM docs))"""


@query(rf"""WITH {DOCS}, s AS ({_section_sql(0, r'\n3\.\d|\n2\.', r'3\.1\.?\s*Knowledge[.\s\x01]+')}
    UNION ALL {_section_sql(1, r'\n\d\.', r'Knowledge[.\s\x01]*(?:is mandatory of|includes?|requires?)[:\s\x01]+')}
    UNION ALL {_section_sql(2, r'\n|\.{2,}', r'(?:principles?|theory|concepts?)[\s\x01]+of[:\s\x01]+')})
  SELECT afsc_doc_id, pattern_no, pos, left(hit, 1500) AS passage FROM s""")
def x12_knowledge_sections(spark, d):
    return extract.knowledge_sections(_texts(spark, d), "afsc_doc_id", "text")


def _with_text(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the text of their document."""
    c = table(spark, d, "ksa_candidates_v0_raw").where(F.col("text_norm").isNotNull()).select("candidate_id", "afsc_doc_id", "text_norm")
    return c.join(_texts(spark, d), "afsc_doc_id")


_JOINED = f"{DOCS}, c AS (SELECT candidate_id, text_norm, evidence, text FROM ksa_candidates_v0_raw JOIN docs USING (afsc_doc_id))"
_STRIP_X = S.strip("x")


@query(rf"""WITH {_JOINED}, t AS (SELECT candidate_id, text, lower(text) AS low, list_filter(regexp_split_to_array(lower(text_norm), '[\t\n\x0b\f\r ]+'), lambda w: length(w) > 3)[1:3] AS terms,
    list_transform(string_split(regexp_replace(text, '([.!?])[\t\n\x0b\f\r ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP_X}) AS ss FROM c WHERE text_norm IS NOT NULL),
  m AS (SELECT *, list_transform(ss, lambda x, i: {{'score': len(list_filter(terms, lambda w: contains(lower(x), w))) * 1000 - length(x), 'place': -i, 's': x, 'n': len(list_filter(terms, lambda w: contains(lower(x), w)))}}) AS sc,
    list_filter(terms, lambda w: contains(low, w))[1] AS term FROM t),
  b AS (SELECT *, list_max(list_filter(sc, lambda y: length(y.s) >= 20 AND y.n >= 2 AND y.score > 0)) AS best, instr(low, term) AS hit_at FROM m)
  SELECT candidate_id, CASE WHEN len(terms) = 0 THEN {S.strip('left(text, 150)')} || '...' WHEN best IS NOT NULL THEN left(best.s, 200)
    WHEN term IS NOT NULL THEN '...' || {S.strip('substr(text, greatest(hit_at - 51, 0) + 1, hit_at - 1 + length(term) + 100 - greatest(hit_at - 51, 0))')} || '...' ELSE {S.strip('left(text, 150)')} || '...' END AS evidence FROM b""")
def x15_evidence_sentence(spark, d):
    return _with_text(spark, d).select("candidate_id", extract.evidence_sentence("text", "text_norm").alias("evidence"))


@query(rf"""WITH {_JOINED} SELECT candidate_id, coalesce(left(regexp_extract_all(right(left(text, greatest(instr(text, evidence) - 1, 0)), 200), '(\d+\.\d+\.?\s*[A-Z][^.]+)', 1)[-1], 20), '3.1 Knowledge') AS section FROM c WHERE evidence IS NOT NULL""")
def x16_section_label(spark, d):
    at = F.greatest(F.instr("text", F.col("evidence")) - 1, F.lit(0))
    c = table(spark, d, "ksa_candidates_v0_raw").where(F.col("evidence").isNotNull()).select("candidate_id", "afsc_doc_id", "evidence").join(_texts(spark, d), "afsc_doc_id")
    return c.select("candidate_id", extract.section_label(F.col("text"), at).alias("section"))


@query(rf"""WITH {_JOINED}, w AS (SELECT candidate_id, text, list_filter(regexp_split_to_array(text_norm, '[\t\n\x0b\f\r ]+'), lambda w: w <> '')[1:3] AS ws FROM c WHERE text_norm IS NOT NULL),
  h AS (SELECT *, CASE WHEN len(ws) > 0 THEN regexp_extract(text, '(?i)\b' || array_to_string(list_transform(ws, lambda w: regexp_escape(w)), '\s+'), 0) ELSE '' END AS hit FROM w),
  a AS (SELECT *, instr(text, hit) AS hit_at FROM h)
  SELECT candidate_id, CASE WHEN hit = '' THEN '' ELSE '...' || {S.strip('substr(text, greatest(hit_at - 101, 0) + 1, hit_at - 1 - greatest(hit_at - 101, 0) + length(hit) + 100)')} || '...' END AS evidence FROM a""")
def x17_evidence_window(spark, d):
    return _with_text(spark, d).select("candidate_id", extract.evidence_window("text", "text_norm").alias("evidence"))


_hits = {k: " + ".join(f"contains(s, '{w}')::INT" for w in ws) for k, ws in extract.CLASS_WORDS.items()}


@query(f"""WITH n AS (SELECT item_id, {_hits['knowledge']} AS k, {_hits['skill']} AS sk, {_hits['ability']} AS a FROM (SELECT item_id, lower(name) AS s FROM ksa_item WHERE name IS NOT NULL))
  SELECT item_id, CASE WHEN k > 0 AND k >= sk AND k >= a THEN 'knowledge' WHEN sk > 0 AND sk >= a THEN 'skill' WHEN a > 0 THEN 'ability' ELSE 'skill' END AS class FROM n""")
def x18_classified(spark, d):
    return table(spark, d, "ksa_item").where(F.col("name").isNotNull()).select("item_id", extract.classified("name").alias("class"))


#: A code of these tables: as headers have it, with a suffix.
SUFFIXED_CODE = rf"{extract.SECTION_CODE}(?:-[0-9A-Z]+)?"


@query(f"""SELECT source_pdf, CAST(row_number() OVER (PARTITION BY source_pdf ORDER BY coalesce(page_start, 1 << 30), afsc_doc_id) - 1 AS INTEGER) AS sec_no, afsc_doc_id, {S.strip('code')} AS code,
    CASE WHEN {S.squeeze("coalesce(title, '')")} = '' THEN 'untitled' ELSE {S.squeeze("coalesce(title, '')")} END AS title, {S.strip("regexp_replace(coalesce(clean_text, raw_text, ''), '[' || chr(1) || chr(2) || ']', ' ', 'g')")} AS section, true AS same
    FROM afsc_doc WHERE source_pdf IS NOT NULL AND code IS NOT NULL""")
def x19_sections(spark, d):
    """All records of a source file in one text under header lines, in order of pages, split again and held against the records.

    One row a section or record: source_pdf, sec_no, afsc_doc_id of the record in this place, code, title, section, and
    whether these are the record's (same). Codes are whole, with their suffix. Records without a file or a code can't be
    put under a header with others and are left out; two control characters that the splitter uses become blanks.
    """
    body = F.regexp_replace(F.coalesce("clean_text", "raw_text", F.lit("")), "[\u0001\u0002]", " ")
    title = T.squeeze(F.coalesce("title", F.lit("")))
    record = F.struct(F.coalesce("page_start", F.lit(1 << 30)).alias("page"), "afsc_doc_id", T.strip("code").alias("code"), F.when(title == "", "untitled").otherwise(title).alias("title"), T.strip(body).alias("section"))
    files = table(spark, d, "afsc_doc").where(F.col("source_pdf").isNotNull() & F.col("code").isNotNull()).groupBy("source_pdf").agg(F.array_sort(F.collect_list(record)).alias("records"))
    whole = F.array_join(F.transform("records", lambda r: F.concat(F.lit("AFSC "), r["code"], F.lit(", "), r["title"], F.lit("\n"), r["section"])), "\n\n")
    split = extract.split_sections(files.select("source_pdf", whole.alias("text")), "source_pdf", "text", SUFFIXED_CODE)
    put = files.select("source_pdf", F.posexplode("records")).select("source_pdf", F.col("pos").alias("sec_no"), "col.afsc_doc_id", F.struct("col.code", "col.title", "col.section").alias("_r"))
    same = F.struct("code", "title", "section").eqNullSafe(F.col("_r"))
    return split.join(put, ["source_pdf", "sec_no"], "full").select("source_pdf", "sec_no", "afsc_doc_id", "code", "title", "section", same.alias("same"))


PAGES_SQL = rf"""SELECT doc_id, n_matches, CASE WHEN length(s) <= 700 THEN s WHEN h = '' THEN '[...]' ELSE h || ' [...]' END AS snippet FROM
  (SELECT doc_id, n_matches, s, regexp_extract(left(s, 695), '^(.*) ', 1) AS h FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)shift')) AS INTEGER) AS n_matches, {S.squeeze('text')} AS s FROM documents WHERE contains(lower(text), 'shift')))"""


@query(PAGES_SQL)
def x20_a19_search_pages(spark, d):
    return extract.search_pages(table(spark, d, "documents"), "doc_id", "text", "shift")


@query(PAGES_SQL + " ORDER BY doc_id LIMIT 50")
def x20_first_pages(spark, d):
    return extract.search_pages(table(spark, d, "documents"), "doc_id", "text", "shift", most=50)


def _matches_sql(pattern: str) -> str:
    return rf"""SELECT doc_id, match_no, char_start, hit, {S.squeeze("substr(text, greatest(char_start - 60, 0) + 1, char_start - greatest(char_start - 60, 0) + length(hit) + 60)")} AS snippet FROM
  (SELECT doc_id, text, CAST(k - 1 AS INTEGER) AS match_no, h[k] AS hit, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS char_start FROM
    (SELECT doc_id, text, h, p, unnest(range(1, len(h) + 1)) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '(?i){pattern}') AS h, string_split_regex(text, '(?i){pattern}') AS p FROM documents WHERE text IS NOT NULL)))"""


@query(_matches_sql(r"\b(?:radar|sensor)[a-z]*"))
def x21_search_matches(spark, d):
    return extract.search_matches(table(spark, d, "documents"), "doc_id", "text", extract.search_pattern(r"\b(?:radar|sensor)[a-z]*"))


@query(f"SELECT * FROM ({_matches_sql(chr(92) + 'b1N0[A-Z0-9]*' + chr(92) + 'b')}) ORDER BY doc_id, char_start LIMIT 100")
def x21_search_codes(spark, d):
    """Codes that begin as the query does, the first hundred of all documents."""
    return extract.search_matches(table(spark, d, "documents"), "doc_id", "text", extract.search_pattern(" 1n0", code=True), most=100)


@query(rf"""SELECT doc_id, CASE WHEN length(s) <= 80 THEN s WHEN h = '' THEN '[...]' ELSE h || ' [...]' END AS text
  FROM (SELECT doc_id, s, regexp_extract(left(s, 75), '^(.*) ', 1) AS h FROM (SELECT doc_id, {S.squeeze('text')} AS s FROM documents WHERE text IS NOT NULL))""")
def x22_short(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.short("text", 80).alias("text"))


@query("SELECT doc_id, regexp_replace(text, '(?i)(safety)', '**\\1**', 'g') AS text FROM documents WHERE text IS NOT NULL")
def x23_highlighted(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", extract.highlighted("text", "safety").alias("text"))


@query(f"""WITH {S.ITEMS} SELECT ord, upper(item_type) AS item_type, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS text, format('{{:.2f}}', coalesce(confidence, 0)) AS confidence FROM items""")
def r07_display(spark, d):
    i = items_of(table(spark, d, "rels_requires"))
    return i.select("ord", F.upper("item_type").alias("item_type"), F.when(F.length("text") > 80, F.concat(F.left("text", F.lit(80)), F.lit("..."))).otherwise(F.col("text")).alias("text"), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
