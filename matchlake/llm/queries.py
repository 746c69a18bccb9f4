"""The operators applied to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import chat, decontam, divergence, line_dedup, order_minhash, pii, quality, resample, sentencepiece_codec, simhash, suffix, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(_table(spark, sf_dir, "conversations"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs)).select("_row.doc_id", *pii.COUNTS, "base_sha256", "spans", "n_spans")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = sentencepiece_codec.round_trip(docs, ["doc_id"])
    ids = F.size("ids").cast("long").alias("n_ids"), sentencepiece_codec.digest(F.col("ids")).alias("ids_xxh64")
    return both.select("_row.doc_id", *ids, "decoded_sha256", "round_trip")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("_row.page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.simhash_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_chat, op3_pii, op4_decontamination, op5_sentencepiece, op6_url_filters, op7_line_dedup, op8_quality, op9_simhash, op10_suffix,
        op11_divergence, op12_resampling, op13_order_minhash,
    )
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = f"""
WITH placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place, role, text FROM conversations),
convs AS (SELECT conv_id, count(*) AS n, list({{'r': role, 't': text}} ORDER BY place) AS turns,
  string_agg('{chat.BEFORE_ROLE}' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS chat FROM placed GROUP BY conv_id),
whole AS (SELECT turns, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM convs GROUP BY turns, n),
proper AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM whole))
SELECT w.conv_id, w.n AS n_turns, w.n_copies, c.chat FROM whole w JOIN convs c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.turns NOT IN (SELECT turns FROM proper)
"""

#: Base columns by pattern; spans beyond the base come from trained trees, so there is no SQL for op3.


def _hits(terms: tuple[tuple[str, int], ...], weighed: bool = False) -> str:
    said = "CAST(regexp_matches(lower(u), '(^|[^\\p{{L}}\\p{{N}}]){}([^\\p{{L}}\\p{{N}}]|$)') AS INTEGER)"
    return " + ".join(said.format(t) + (f" * {w}" if weighed else "") for t, w in terms)


_STRICT, _SOFT = ([t for t in url_filter.TERMS if (t[1] >= url_filter.LIMIT) == strict] for strict in (True, False))

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS mark FROM pages),
h AS (SELECT page_id, u, CASE WHEN mark > 0 THEN regexp_extract(substr(u, mark + 3), '^[^/?#]*') ELSE '' END AS raw, CASE WHEN mark > 0 THEN substr(u, mark + 3) ELSE '' END AS rest FROM p),
s AS (SELECT page_id, u, {LOWER.format("raw")} AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, v) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in url_filter.RULES)}),
fit AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
hit AS (SELECT page_id, {_hits(_STRICT)} AS n_strict, {_hits(_SOFT)} AS n_soft, {_hits(url_filter.TERMS, True)} AS weight FROM s)
SELECT s.page_id, s.host, s.path, fit.rule, coalesce(fit.v, CASE WHEN weight >= {url_filter.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(coalesce(n_strict, 0) AS INTEGER) AS n_strict, CAST(coalesce(n_soft, 0) AS INTEGER) AS n_soft, CAST(coalesce(weight, 0) AS INTEGER) AS weight
FROM s LEFT JOIN fit USING (page_id) LEFT JOIN hit USING (page_id)
"""

OP7 = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, s.first IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""

_WORD = r"[^\x20\x09-\x0D]+"
_HIST = ", ".join(f"r.{c} AS r_{c}" for c in (*quality.CLASSES, *quality.BINS))


def _js(names: tuple[str, ...]) -> str:
    p, q = "(" + " + ".join(names) + ")", "(" + " + ".join(f"r_{n}" for n in names) + ")"
    term = "CASE WHEN {a} > 0 THEN {x} * ln(2 * {x} / ({a}::DOUBLE / {p} + {b}::DOUBLE / {q})) ELSE 0 END"
    parts = []
    for n in names:
        parts.append(term.format(a=n, b=f"r_{n}", p=p, q=q, x=f"({n}::DOUBLE / {p})"))
        parts.append(f"CASE WHEN r_{n} > 0 THEN (r_{n}::DOUBLE / {q}) * ln(2 * (r_{n}::DOUBLE / {q}) / ({n}::DOUBLE / {p} + r_{n}::DOUBLE / {q})) ELSE 0 END")
    return f"CASE WHEN {p} > 0 AND {q} > 0 THEN sqrt(greatest(0, {' + '.join(parts)}) / (2 * ln(2.0))) END"


_COMMON = ", ".join(
    "CASE "
    + " ".join(f"WHEN lang = '{lang}' THEN " + (f"len(list_filter(words, lambda x: x IN ('{w[i]}', '{w[i].capitalize()}')))" if i < len(w) else "0") for lang, w in quality.LANGUAGES.items())
    + f" ELSE 0 END AS {c}"
    for i, c in enumerate(quality.BINS[:-1])
)

OP8 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
runs AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) >= 8),
hashed AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS run FROM runs),
twice AS (SELECT doc_id, i FROM hashed QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
gaps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS g FROM twice),
rep AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS n_repeat_words FROM gaps GROUP BY doc_id),
base AS (SELECT d.doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, length(text) AS chars,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS c_upper, len(regexp_extract_all(text, '[0-9]')) AS c_digit, len(regexp_extract_all(text, '[.,;:!?()''"-]')) AS c_point,
  len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS c_symbol, length(text) - length(array_to_string(words, '')) AS c_space, {_COMMON} FROM d LEFT JOIN rep USING (doc_id)),
hist AS (SELECT *, chars - c_upper - c_digit - c_point - c_symbol - c_space AS c_rest, n_words - ({" + ".join(quality.BINS[:-1])}) AS w_rest FROM base),
reference AS (SELECT lang, {", ".join(f"sum({c}) AS {c}" for c in (*quality.CLASSES, *quality.BINS))} FROM hist WHERE lang IN ('en', 'de', 'fr', 'es') GROUP BY lang),
joined AS (SELECT hist.*, {_HIST} FROM hist LEFT JOIN reference r USING (lang)),
js AS (SELECT *, CASE WHEN chars >= {quality.CHARS_FROM} THEN {_js(quality.CLASSES)} END AS js_chars, CASE WHEN n_words >= {quality.WORDS_FROM} THEN {_js(quality.BINS)} END AS js_words,
  n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(js_chars > {quality.MAX_CHARS_DISTANCE}, false) AND NOT coalesce(js_words > {quality.MAX_WORDS_DISTANCE}, false) AS kept FROM js
"""

OP11 = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
  regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n, count(DISTINCT doc) AS docs FROM (SELECT lang, source, doc, unnest(words) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
whole AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
own AS (SELECT lang, source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(own.total, 0) + 5 * whole.v) AS p,
  1 + (1000000000 * (k.n + 5)) // (whole.total + 5 * whole.v) AS q
  FROM g JOIN k USING (lang) JOIN whole USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM m x JOIN m y ON x.lang = y.lang AND x.term = y.term
  WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM m WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

SQL = {"op2_chat": OP2, "op6_url_filters": OP6, "op7_line_dedup": OP7, "op8_quality": OP8, "op11_divergence": OP11}
