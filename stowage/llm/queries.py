"""The queries of this folder's operators, each over its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stowage.llm.common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import media

    return media.media_table(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import warc

    return warc.warc_table(_table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import lm_score

    return lm_score.scores(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import url_filter

    return url_filter.url_table(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import mixing

    return mixing.mix_table(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import quality

    return quality.verdicts(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import substring

    return substring.removals(_table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stowage.llm import token_counts

    return token_counts.count_edits(_table(spark, sf_dir, "documents"), token_counts.sample_edits())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


#: The six blanks that separate words, as a RE2 class of all other characters.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_WARC = """WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, CAST(from_hex(h) AS BIT)::VARCHAR AS bits FROM f)
SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, CAST(5 * k + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * k + 2 AS INTEGER), 1) AS INTEGER) + 4 * CAST(substr(bits, CAST(5 * k + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * k + 4 AS INTEGER), 1) AS INTEGER) + CAST(substr(bits, CAST(5 * k + 5 AS INTEGER), 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  url, CASE WHEN page_id = first THEN octet_length(b) ELSE 0 END AS stored_bytes FROM d"""

_MIX = f"""WITH n AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST(1 + rank % 3 AS DOUBLE) AS weight FROM r),
l AS (SELECT *, 3.0::DOUBLE * source_size AS full_size, (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN level * weight > full_size THEN full_size ELSE least(first(level) OVER (ORDER BY level * weight > full_size, source_size / weight, rank) * weight, full_size) END AS target FROM l),
p AS (SELECT n.doc_id, n.size, t.source_size, t.target, t.rank, CAST(coalesce(sum(n.size) OVER (PARTITION BY n.source ORDER BY n.h % 4096, n.h, n.doc_id, n.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN size > 0 THEN CAST(start + size / 2 <= target AS INTEGER) + CAST(start + size / 2 + source_size <= target AS INTEGER) + CAST(start + size / 2 + 2 * source_size <= target AS INTEGER) ELSE 0 END AS copies,
  least(start / greatest(target, 1e-9), 1.0) AS u FROM p),
x AS (SELECT *, CASE rank % 3 WHEN 0 THEN u WHEN 1 THEN (sqrt(greatest(2.25 + 2 * (0.5 - 1.5) * u * 1.0, 0.0)) - 1.5) / (0.5 - 1.5) ELSE (sqrt(greatest(0.25 + 2 * (1.5 - 0.5) * u * 1.0, 0.0)) - 0.5) / (1.5 - 0.5) END AS due FROM c)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, copies * size AS taken, CASE WHEN copies > 0 THEN CASE WHEN due <= 0 THEN 0.0::DOUBLE WHEN due >= 1 THEN 1.0::DOUBLE ELSE due::DOUBLE END END AS position FROM x"""

_REPEATS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, w FROM d),
o AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= n_words THEN array_to_string(w[i : i + 19], ' ') END AS win FROM k),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM o),
g AS (SELECT doc_id, i, word, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM f),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""


def _quality() -> str:
    """The SQL of quality: its counts, its votes, and the steps of the maximisation one after the other."""
    from stowage.llm import quality as q

    blank = r"[\x20\x09-\x0D]"
    dropped = "length(regexp_replace(t, '{}', '', 'g'))".format
    rules = {
        "symbols": ("n_symbols / greatest(n_words, 1)", "x > 0.15", "x <= 0.05"),
        "marks": ("n_marks / greatest(n_words, 1)", "x > 0.35", "x <= 0.25"),
        "repetition": ("n_repeat_words / greatest(n_words, 1)", "x > 0.35", "x <= 0.1"),
        "lines": ("n_dup_lines / greatest(n_lines, 1)", "x > 0.4", "x <= 0.1"),
        "shouting": ("n_capitals / greatest(word_chars, 1)", "x > 0.5", "x <= 0.15"),
        "word_length": ("word_chars / greatest(n_words, 1)", "x < 2 OR x > 20", "x >= 3 AND x <= 12"),
    }
    names = [f"v_{r}" for r in q.RULES]
    vote = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad.replace('x', f'({x})')} THEN -1 WHEN {good.replace('x', f'({x})')} THEN 1 ELSE 0 END AS v_{r}" for r, (x, bad, good) in ((r, rules[r]) for r in q.RULES))
    cols = ", ".join(names)
    steps = [f"p0 AS MATERIALIZED (SELECT *, CASE WHEN least({cols}) < 0 THEN 0.1::DOUBLE ELSE 0.95::DOUBLE END AS p, 1.0::DOUBLE AS moved FROM (SELECT {cols}, count(*) AS n FROM votes GROUP BY ALL))"]
    for k in range(q.STEPS):
        joins = " ".join(f"JOIN o{k} AS a{j} ON a{j}.j = {j} AND a{j}.v = p{k}.{name}" for j, name in enumerate(names))
        total = " + ".join(f"a{j}.o" for j in range(len(names)))
        steps += [
            f"m{k} AS MATERIALIZED (SELECT j, v, sum(n * p) AS g, sum(n * (1 - p)) AS b FROM (SELECT unnest({list(range(len(names)))}) AS j, unnest([{cols}]) AS v, n, p FROM p{k}) GROUP BY j, v)",
            f"t{k} AS MATERIALIZED (SELECT sum(g) + 1 AS good, sum(b) + 1 AS bad FROM m{k} WHERE j = 0)",
            f"o{k} AS MATERIALIZED (SELECT j, v, CASE v WHEN -1 THEN least(x, 0) WHEN 1 THEN greatest(x, 0) ELSE 0 END AS o FROM (SELECT j, v, ln((g + 1) / (good + 2)) - ln((b + 1) / (bad + 2)) AS x FROM m{k}, t{k}))",
            f"p{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (q, was), q AS p, abs(q - was) AS moved FROM (SELECT p{k}.* EXCLUDE (p, moved), p{k}.p AS was, 1 / (1 + exp(-(ln((good / (good + bad)) / (1 - good / (good + bad))) + {total}))) AS q FROM p{k}, t{k} {joins}))",
        ]
    steps.append("every AS (" + " UNION ALL ".join(f"SELECT {k} AS k, {cols}, p, moved FROM p{k}" for k in range(1, q.STEPS + 1)) + ")")
    steps.append(f"settled AS (SELECT coalesce(min(k), {q.STEPS}) AS k FROM (SELECT k FROM every GROUP BY k HAVING max(moved) < {q.SETTLED}))")
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
k AS (SELECT doc_id, i, w[i : i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM k) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, {dropped(blank + "+")} AS word_chars, length(t) - length(translate(t, '{q.SYMBOLS}', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, {dropped("[^\\p{Lu}]+")} AS n_capitals, {dropped("[\\p{L}\\p{M}\\p{N}\\s]+")} AS n_marks FROM w LEFT JOIN rep USING (doc_id)),
votes AS (SELECT *, {vote}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= {q.KEEP_AT} AS kept, round(p, 6) AS p_good FROM votes JOIN (SELECT * FROM every WHERE k = (SELECT k FROM settled)) USING ({cols})"""


#: Rounds that the SQL has, more than ranks on these pages take to settle.
_URL_ROUNDS = 64


def _urls() -> str:
    """The SQL of url_filter: its rounds one after the other."""
    from stowage.llm import url_filter as u

    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    fits = [(says, rule, rule.split("/")[0], rule[rule.index("/") :]) for says, rule in sorted(u.RULES, key=lambda x: (-len(x[1]), x[1]))]
    when = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for _, _, h, p in fits]
    link = u.LINK.replace("'", "''")
    tail = "array_to_string(l[{} :], '.')".format
    rounds = [f"r0 AS MATERIALIZED (SELECT kind, host, seed * (1 - {u.DAMPING}) AS rank, seed * (1 - {u.DAMPING}) AS added FROM seeds)"]
    for k in range(1, _URL_ROUNDS + 1):
        rounds.append(
            f"r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) + sum(added) AS rank, sum(added) AS added FROM (SELECT r.kind, e.dst AS host, 0.0::DOUBLE AS rank, r.added * e.share * {u.DAMPING} AS added FROM r{k - 1} r JOIN shares e ON r.kind = e.kind AND r.host = e.src"
            f" UNION ALL SELECT kind, host, rank, 0.0 FROM r{k - 1}) GROUP BY kind, host)"
        )
    ends = range(u.WRITE_EVERY, _URL_ROUNDS + 1, u.WRITE_EVERY)
    rounds.append("every AS (" + " UNION ALL ".join(f"SELECT {k} AS k, * FROM r{k}" for k in ends) + ")")
    rounds.append(f"settled AS (SELECT min(k) AS k FROM (SELECT k FROM every GROUP BY k HAVING max(added / rank) <= {u.SETTLED}))")
    of = lambda kind: f"round(sum(CASE WHEN kind = '{kind}' THEN rank ELSE 0.0 END), 9) AS {kind}"
    return f"""WITH p AS (SELECT page_id, html, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, CASE {" ".join(w + f"'{r}'" for w, (_, r, _, _) in zip(when, fits, strict=True))} END AS rule, CASE {" ".join(w + f"'{s}'" for w, (s, _, _, _) in zip(when, fits, strict=True))} END AS said FROM p),
links AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT host AS src, {lower(f"unnest(regexp_extract_all(html, '{link}', 1))")} AS dst FROM p) GROUP BY src, dst),
hosts AS (SELECT DISTINCT string_split(host, '.') AS l FROM (SELECT host FROM p UNION ALL SELECT dst FROM links) WHERE host <> ''),
owned AS (SELECT l, CASE WHEN {tail("len(l) - 1")} IN ({", ".join(f"'{x}'" for x in u.SUFFIXES)}) THEN 3 ELSE 2 END AS own FROM hosts WHERE len(l) > 2),
family AS (SELECT DISTINCT {tail("k")} AS src, {tail("k + 1")} AS dst, CAST({u.FAMILY} AS DOUBLE) AS weight FROM (SELECT l, unnest(range(1, len(l) - own + 1)) AS k FROM owned WHERE len(l) > own)),
edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM links UNION ALL SELECT * FROM family UNION ALL SELECT dst, src, weight FROM family) WHERE src <> dst AND src <> '' GROUP BY src, dst),
ways AS (SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
shares AS (SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM ways),
seeds AS (SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, CAST(count(*) AS DOUBLE) AS seed FROM j WHERE said IS NOT NULL AND host <> '' GROUP BY 1, 2),
{", ".join(rounds)},
s AS (SELECT host, {of("trust")}, {of("distrust")} FROM every WHERE k = (SELECT k FROM settled) GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN distrust > trust * {u.THRESHOLD} THEN 'block' END, 'allow') AS verdict, coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust FROM j LEFT JOIN s ON j.host = s.host"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _WARC, "op5_url_filter": _urls(), "op6_mixing": _MIX, "op7_quality": _quality(), "op9_substring": _REPEATS}
