"""The queries of this subpackage over the tables in a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm import divergence, licenses, linededup, mixing, mtree, packing, pieces, quality, quotes, render, simhash, spelling, tokenfiles
from lattix.llm.shared import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=3, shingle=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    first = F.round(F.get("visits", 0)["position"], 6)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("visits").alias("visits"), first.alias("position")).orderBy("position", "doc_id")


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_order(quotes.link_quotes(_table(spark, sf_dir, "conversations")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op5_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.rendered(_table(spark, sf_dir, "pages")).select("page_id", "url", "text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/lattix-tokens-{uuid.uuid4().hex}"
    tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), to)
    return tokenfiles.read_tokens(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.sort_array("removed"), ",").alias("removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = pieces.decoded(pieces.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), misspelt=spelling.MISSPELT)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_quotes, op4_quality, op5_render, op6_packing, op7_licenses, op8_tokenfiles, op9_mtree, op10_linededup, op11_pieces, op12_divergence, op13_spelling)}

_LOW = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(low: str) -> str:
    text = f"' ' || replace(trim(regexp_replace({low}, {_quoted(licenses.PUNCTUATION)}, ' ', 'g')), ' ', '  ') || ' '"
    for old, new in licenses.EQUIVALENT:
        text = f"replace({text}, {_quoted(licenses.spaced(old))}, {_quoted(licenses.spaced(new))})"
    return f"replace(trim({text}), '  ', ' ')"


def _op7_sql() -> str:
    known = ", ".join(f"({i}, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(licenses.KNOWN))
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_LOW}), lambda y: NOT regexp_matches(y, {_quoted(licenses.COPYRIGHT_LINE)}))"
    whole = _canonical_sql("array_to_string(ls, chr(10))")
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS k(n, license, text)),
forms AS (SELECT n, license, {whole} AS w FROM (SELECT n, license, {lines} AS ls FROM known)),
digests AS (SELECT sha256(w) AS k_digest, arg_min(license, n) AS license FROM forms WHERE w <> '' GROUP BY 1),
found AS (SELECT row_number() OVER () AS r, doc_id, {lines} AS ls FROM documents),
numbered AS (SELECT r, doc_id, ls, {whole} AS w FROM found),
notices AS (SELECT r, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT r, d.license FROM (SELECT r, sha256(unnest(list_transform(ls, lambda x: {_canonical_sql('x')}))) AS line FROM numbered) x JOIN digests d ON x.line = d.k_digest) GROUP BY r)
SELECT doc_id, CASE WHEN w <> '' THEN sha256(w) END AS digest, license, notices FROM numbered LEFT JOIN digests ON w <> '' AND sha256(w) = k_digest LEFT JOIN notices USING (r)"""


def _op2_sql() -> str:
    sizes = r"SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents"
    cases = []
    for kind, knots in mixing.SCHEDULES.items():
        areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
        done = [sum(areas[:i]) / sum(areas) for i in range(len(areas) + 1)]
        for i, (a, b) in enumerate(zip(knots, knots[1:])):
            part = f"((s - {done[i]}::DOUBLE) / {done[i + 1] - done[i]}::DOUBLE)"
            root = f"sqrt(greatest({a[1]}::DOUBLE * {a[1]} + {part} * ({b[1]}::DOUBLE * {b[1]} - {a[1]}::DOUBLE * {a[1]}), 0.0))"
            cases.append(f"WHEN class = {kind} AND (s <= {done[i + 1]}::DOUBLE OR {done[i + 1]}::DOUBLE >= 1) THEN {a[0]}::DOUBLE + {b[0] - a[0]}::DOUBLE * {part} * {a[1] + b[1]}::DOUBLE / ({a[1]}::DOUBLE + {root})")
    rest = "(round(target)::BIGINT - {e} * source_size - before)"
    words = [f"greatest(0, least(size, {rest.format(e=e)}))" for e in range(mixing.MOST_EPOCHS)]
    return f"""
WITH sizes AS ({sizes}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
classed AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS class, 3 * source_size AS cap FROM sources),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / class, class, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(class) OVER (ORDER BY cap / class, class, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM classed),
chosen AS (SELECT arg_min(level, {{'ratio': cap / class, 'less': -level}}) AS level FROM leveled WHERE level * class <= cap),
targets AS (SELECT source, source_size, class, CASE WHEN chosen.level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, chosen.level * class) END AS target FROM leveled LEFT JOIN chosen ON true),
placed AS (SELECT s.doc_id, s.size, t.*, (sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, 'null') || ':0'), s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS before FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
visited AS (SELECT *, {', '.join(f'{w} AS w{e}' for e, w in enumerate(words))}, least(before / target, 1.0) AS s FROM placed)
SELECT doc_id, size, source_size, target, ({' + '.join(f'w{e}' for e in range(len(words)))})::BIGINT AS taken,
  ({' + '.join(f'(w{e} > 0)::INTEGER' for e in range(len(words)))})::INTEGER AS visits,
  CASE WHEN w0 > 0 THEN round(CASE {' '.join(cases)} END, 6) END AS position
FROM visited"""


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

OP10_SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS ln FROM d),
f AS (SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
n AS (SELECT doc_id, text, ln, line, row_number() OVER (PARTITION BY doc_id, text ORDER BY ln) AS pos,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM f WHERE line <> ''),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, text ORDER BY pos) AS cum FROM n),
a AS (SELECT doc_id, text, list(line ORDER BY pos) AS lines FROM c GROUP BY doc_id, text),
forward AS (SELECT x.doc_id, x.text, x.pos AS first, min(y.pos) AS last FROM c x JOIN c y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.text = y.text
  AND y.pos >= x.pos AND y.pos < x.pos + {linededup.MIN_WORDS} AND y.cum - x.cum + x.w >= {linededup.MIN_WORDS} GROUP BY 1, 2, 3),
backward AS (SELECT y.doc_id, y.text, max(x.pos) AS first, y.pos AS last FROM c x JOIN c y ON x.doc_id IS NOT DISTINCT FROM y.doc_id AND x.text = y.text
  AND y.pos >= x.pos AND y.pos < x.pos + {linededup.MIN_WORDS} AND y.cum - x.cum + x.w >= {linededup.MIN_WORDS} GROUP BY 1, 2, 4),
windows AS (SELECT DISTINCT * FROM (SELECT doc_id, text, first, last FROM forward UNION ALL SELECT doc_id, text, first, last FROM backward)),
named AS (SELECT w.*, array_to_string(list_slice(a.lines, w.first, w.last), chr(10)) AS body FROM windows w JOIN a ON w.doc_id IS NOT DISTINCT FROM a.doc_id AND w.text = a.text),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, text, first) AS nth FROM named) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(first, last + 1)) AS pos FROM later),
removed AS (SELECT g.doc_id, g.text, list(n.ln ORDER BY n.ln) AS lns FROM gone g JOIN n ON g.doc_id IS NOT DISTINCT FROM n.doc_id AND g.text = n.text AND g.pos = n.pos GROUP BY 1, 2),
kept AS (SELECT l.doc_id, l.text, string_agg(raw, chr(10) ORDER BY ln) AS out FROM l JOIN removed r ON l.doc_id IS NOT DISTINCT FROM r.doc_id AND l.text = r.text
  WHERE NOT list_contains(r.lns, ln) GROUP BY 1, 2)
SELECT o.doc_id, coalesce(len(string_split(o.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(r.lns), 0)::BIGINT AS n_removed,
  coalesce(array_to_string(r.lns, ','), '') AS removed, md5(CASE WHEN r.lns IS NULL THEN o.text ELSE coalesce(k.out, '') END) AS text_md5
FROM documents o LEFT JOIN removed r ON o.doc_id IS NOT DISTINCT FROM r.doc_id AND o.text = r.text LEFT JOIN kept k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text = k.text"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (SELECT *, 1 + {divergence.UNIT}::HUGEINT * (n + {divergence.SMOOTH}) // (sum(n) OVER (PARTITION BY lang, source) + {divergence.SMOOTH} * count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
whole AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL),
langs AS (SELECT lang, term, 1 + {divergence.UNIT}::HUGEINT * (n + {divergence.SMOOTH}) // (sum(n) OVER (PARTITION BY lang) + {divergence.SMOOTH} * count(*) OVER (PARTITION BY lang)) AS q FROM whole),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(v.value), 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y USING (lang, term) GROUP BY ALL) v ON v.lang = a.lang AND v.a = a.source AND v.b = b.source GROUP BY ALL),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, (p - q)::BIGINT AS value FROM shares s JOIN langs l USING (lang, term) WHERE n > 0 AND p > q),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranks WHERE part = 'pair' OR rank <= {divergence.TOP}"""

ORACLES = {"op2_mixing": _op2_sql(), "op7_licenses": _op7_sql(), "op9_mtree": OP9_SQL, "op10_linededup": OP10_SQL, "op12_divergence": OP12_SQL}
