"""One query per operator, over its whole table, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.bpe import encode_texts
from thicket.llm.decontaminate import find_benchmark
from thicket.llm.filter_audit import failures, interactions, postings, subset_sums
from thicket.llm.fim_frames import digests, fill_in_middle, store_frames
from thicket.llm.html_render import extract_text
from thicket.llm.jaccard_join import jaccard_groups
from thicket.llm.licenses import MATCH, TEMPLATES, scan, template_bigrams
from thicket.llm.pii import pseudonymise
from thicket.llm.quality import apply_policy, ledger
from thicket.llm.source_mix import mix_sources
from thicket.llm.substring_dedup import dedup_substrings
from thicket.llm.suffix_dedup import dedup_passages
from thicket.llm.warc import lookup_captures, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def word_bpe() -> str:
    """Path of the public word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def later_windows_sql(window: int) -> str:
    """Words, and the words to remove, for windows of ``window`` words that occur earlier."""
    return rf"""
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {window} + 2)) AS s FROM words),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + {window} - 1], ' ') AS k FROM starts),
later AS (SELECT doc_id, s FROM (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS i FROM (SELECT doc_id, s, unnest(range(0, {window})) AS o FROM later)),
each AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM words),
kept AS (SELECT each.doc_id, count(gone.i) AS n_removed,
    string_agg(CASE WHEN gone.i IS NULL THEN w END, ' ' ORDER BY each.i) AS kept_text
  FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.i = gone.i GROUP BY each.doc_id)"""


ORACLES["op2_substring_dedup"] = f"""WITH {later_windows_sql(20)}
SELECT words.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id"""


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_groups(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


ORACLES["op5_jaccard_join"] = r"""WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS k FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (SELECT shared.a, shared.b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM documents LEFT JOIN sizes ON documents.doc_id = sizes.doc_id JOIN reach ON reach.a = documents.doc_id GROUP BY 1, 2"""


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(table(spark, sf_dir, "documents"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op6_suffix_dedup"] = ORACLES["op2_substring_dedup"].replace(later_windows_sql(20), later_windows_sql(50))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLES["op4_decontamination"] = r"""WITH
texts AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
items AS (SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
phrases AS (SELECT DISTINCT item_id, size, array_to_string(ws[s:s + size - 1], ' ') AS k FROM (
  SELECT item_id, ws, least(len(ws), 10) AS size, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
windows AS (SELECT doc_id, size, s, array_to_string(ws[s:s + size - 1], ' ') AS k FROM (
  SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS s FROM texts, sizes WHERE len(ws) >= size)),
hits AS (SELECT DISTINCT doc_id, s, windows.size AS size, item_id FROM windows JOIN phrases ON windows.k = phrases.k AND windows.size = phrases.size),
hit_words AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS i FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT texts.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit_words.n, 0)::BIGINT AS n_hit, coalesce(hit_items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, hit_words.n IS NOT NULL AS contaminated
FROM texts LEFT JOIN hit_words ON hit_words.doc_id = texts.doc_id LEFT JOIN hit_items ON hit_items.doc_id = texts.doc_id"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")), "v1")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failed", "base_failed", "kept"
    )


ORACLES["op8_quality_rules"] = r"""WITH
words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
windows AS (SELECT doc_id, s, array_to_string(ws[s:s + 2], ' ') AS k FROM (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS s FROM words)),
often AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT s + o) AS n FROM (SELECT doc_id, s, unnest([0, 1, 2]) AS o FROM often) GROUP BY doc_id),
measured AS (SELECT words.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats ON repeats.doc_id = words.doc_id),
bits AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
  + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
  + 64 * (n_words > 1000000)::BIGINT)::BIGINT AS failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, failed,
  (failed & 3) <> 0 AS base_failed, (failed & 55) = 0 AS kept FROM bits"""


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"), word_bpe())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = lookup_captures(write_archive(pages), pages)
    # the digest of a response is taken anew from the payload that was read back
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).alias("payload_sha1")
    return out.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", digest)


#: The key of the registered query; a real run passes its own secret.
PSEUDONYM_KEY = b"registered query"


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text", "n_found", "found")


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.concat_ws(",", "licenses").alias("licenses"), "n_matches", "best")


def _license_sql() -> str:
    num, den = MATCH
    grams = template_bigrams(TEMPLATES)
    rows = ", ".join(f"('{name}', [{', '.join(repr(x) for x in b)}])" for name, b in sorted(grams.items()))
    high = max(len(b) * (2 * den - num) // num for b in grams.values())
    low = min(-(-len(b) * num // (2 * den - num)) for b in grams.values())
    return rf"""WITH
templates(name, b) AS (VALUES {rows}),
units AS (SELECT DISTINCT doc_id, u FROM (
  SELECT doc_id, unnest(list_concat(list_concat(string_split(coalesce(text, ''), chr(10)),
    regexp_split_to_array(coalesce(text, ''), '\n[\x20\x09-\x0D]*\n')), list_concat([coalesce(text, '')],
    string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1))))) AS u FROM documents)),
words AS (SELECT doc_id, u, regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM units),
bigrams AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM words WHERE len(w) > {low} AND len(w) <= {high} + 1),
rated AS (SELECT doc_id, u, name, len(list_intersect(bigrams.b, templates.b)) AS shared, len(bigrams.b) + len(templates.b) AS total
  FROM bigrams, templates WHERE len(bigrams.b) * {2 * den - num} >= len(templates.b) * {num} AND len(bigrams.b) * {num} <= len(templates.b) * {2 * den - num}),
hits AS (SELECT doc_id, u, max(struct_pack(v := (shared * 2000) // total, name := name)) AS m FROM rated
  WHERE shared * {2 * den} >= total * {num} GROUP BY doc_id, u),
found AS (SELECT doc_id, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS licenses, count(*) AS n, max(m.v) AS best FROM hits GROUP BY doc_id)
SELECT documents.doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_matches, coalesce(best, 0)::BIGINT AS best
FROM documents LEFT JOIN found ON found.doc_id = documents.doc_id"""


ORACLES["op7_license_scan"] = _license_sql()


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digests(fill_in_middle(store_frames(table(spark, sf_dir, "documents")), seed=1))
    return out.withColumnRenamed("id", "doc_id")


ORACLES["op11_fill_in_middle"] = r"""WITH
texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, length(t) AS n, ('0x' || h[1:8])::BIGINT % (length(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (length(t) + 1) AS b,
  ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM texts),
cut AS (SELECT doc_id, t, n, substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, abs(a - b)) AS m, substr(t, greatest(a, b) + 1) AS s,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
    WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM cut"""


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), max_copies=3)
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return interactions(subset_sums(postings(flags)))


ORACLES["op13_filter_audit"] = r"""WITH RECURSIVE
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(texts.doc_id > first, false)::INT AS bits, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM texts JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = texts.doc_id),
cells AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY part, bits),
orders(o, used) AS (SELECT '', 0 UNION ALL
  SELECT o || f, used | b FROM orders, (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, b) WHERE used & b = 0),
steps AS (SELECT o, s, 1 << (ascii(o[s]) - 65) AS own, (SELECT sum(1 << (ascii(c) - 65)) FROM (SELECT unnest(string_split(o[1:s], '')) AS c)) AS upto
  FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS s FROM orders WHERE length(o) = 5)),
sums AS (SELECT part, o, s, own, coalesce(sum(n) FILTER (bits & upto = 0), 0) AS kept,
  coalesce(sum(n) FILTER (bits & own <> 0 AND bits & (upto - own) = 0), 0) AS removed,
  coalesce(sum(n) FILTER (bits & own <> 0 AND bits & (upto - own) <> 0), 0) AS redundant,
  coalesce(sum(n) FILTER (bits = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (bits & own <> 0 AND bits & (upto - own) = 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (bits & own <> 0 AND bits & (upto - own) = 0), 0) AS toxic_lost
  FROM cells, (SELECT o, s, own, upto::INT AS upto FROM steps) GROUP BY part, o, s, own)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM sums"""
