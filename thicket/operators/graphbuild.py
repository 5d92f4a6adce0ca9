"""Documents to a property graph: chunks, extraction responses, entities, attributes, edges.

"First wins" always means first by (document, chunk, position), which does not depend on how
the rows are partitioned. Hot entities are resolved by aggregates that combine before the
shuffle; nothing is gathered per entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import bound, clean_response, tokens
from thicket.ordering import first_per_key
from thicket.session import stage

SEPARATOR = "\u0001"
RESPONSE = (
    "attributes map<string, array<string>>, triples array<array<string>>, entity_types map<string, string>, "
    "new_schema_types struct<nodes: array<string>, relations: array<string>, attributes: array<string>>"
)
WORD = r"\p{Lu}\p{Ll}{2,}"


def key_of(*parts: Column) -> Column:
    """Deterministic id from its parts; a null part differs from an absent and from an empty one."""
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts]), 256)


def chunks(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    title: str | None = None,
    size: int = 1000,
    overlap: int = 50,
    min_tail: int = 100,
    split: bool = True,
    tokenizer: Callable[[Column], Column] = tokens,
    min_piece: int = 5,
) -> DataFrame:
    """(chunk_id, doc_id, ordinal, text, n_tokens).

    Windows of ``size`` tokens start every ``size - overlap``; a start with fewer than
    ``min_tail`` tokens left is dropped and the window before runs to the end. A text of at most
    ``size`` tokens is one chunk, as is any text when ``split`` is off. Pieces of a cut text under
    ``min_piece`` tokens or characters are dropped; 0 keeps all. Only the cut pieces leave the row, not the token array.
    """
    if min_tail > size:
        raise ValueError("min_tail may not exceed size")
    step = size - overlap if size > overlap else size
    body = F.trim(F.concat_ws(" ", title, text)) if title else F.col(text)
    base = docs.select(F.col(doc_id).alias("doc_id"), body.alias("_body"))
    base = base.withColumn("_tok", tokenizer(F.col("_body"))).withColumn("_n", F.size("_tok"))
    whole = F.array(F.struct(F.lit(0).alias("ordinal"), F.col("_body").alias("text"), F.col("_n").alias("n_tokens")))
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)), F.lit(step)),
        lambda s: (s == 0) | (F.col("_n") - s >= min_tail),
    )
    base = base.withColumn("_starts", starts)

    def piece(s: Column, i: Column) -> Column:
        last = i == F.size("_starts") - 1
        end = F.when(last, F.col("_n")).otherwise(F.least(s + size, F.col("_n")))
        return F.struct(
            i.cast("int").alias("ordinal"),
            F.array_join(F.slice("_tok", s + 1, end - s), "").alias("text"),
            (end - s).cast("int").alias("n_tokens"),
        )

    long_enough = lambda c: (c["n_tokens"] >= min_piece) & (F.length(F.trim(c["text"])) >= min_piece)
    pieces = F.filter(F.transform("_starts", piece), long_enough)
    cut = F.when(F.col("_n") > size, pieces).otherwise(whole) if split else whole
    # the outer form keeps the optimizer from testing the array first, which would cut twice
    out = base.select("doc_id", F.inline_outer(cut)).where(F.col("ordinal").isNotNull())
    return out.select(
        F.sha2(F.concat_ws(":", "doc_id", "ordinal"), 256).alias("chunk_id"), "doc_id", "ordinal", "text", "n_tokens"
    )


def rule_responses(pieces: DataFrame) -> DataFrame:
    """Stand-in for a model: capitalized words are entities, neighbours co-occur.

    Gives the same kind of JSON text a model would, or prose when there is nothing to extract.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    base = pieces.withColumn("_w", words)
    n, w = F.size("_w"), F.col("_w")
    pairs = F.transform(
        F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.array(x, F.lit("co_occurs"), F.get(w, i + 1))
    )
    answer = F.struct(
        F.create_map(w[0], F.array(F.concat(F.lit("words: "), n.cast("string")), F.lit("capitalized"))).alias("attributes"),
        pairs.alias("triples"),
        F.create_map(w[0], F.lit("topic")).alias("entity_types"),
    )
    fenced = F.concat(F.lit("```json\n"), F.to_json(answer), F.lit("\n```"))
    return base.select("chunk_id", "doc_id", "ordinal", F.when(n > 0, fenced).otherwise("nothing found").alias("response"))


def extract(pieces: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """Responses of a user's extractor, called in Arrow batches on the executors."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf.assign(response=[fn(t) for t in pdf["text"]]).drop(columns=["text"])

    doc_type = dict(pieces.dtypes)["doc_id"]
    return pieces.select("chunk_id", "doc_id", "ordinal", "text").mapInPandas(
        run, f"chunk_id string, doc_id {doc_type}, ordinal int, response string"
    )


def parse(responses: DataFrame) -> DataFrame:
    """Responses with their parsed content in ``r``; null when the text is not the expected JSON.

    The result is staged: entities, attributes, edges and counts all read it, and extraction is
    the dear step that a lost executor must not repeat.
    """
    return stage(_parse(responses))


def _parse(responses: DataFrame) -> DataFrame:
    parts = ("attributes", "triples", "entity_types")

    def usable(r: Column) -> Column:
        return F.when(reduce(Column.__or__, [r[p].isNotNull() for p in parts]), r)

    return responses.withColumn("r", bound(F.from_json(clean_response(F.col("response")), RESPONSE), usable))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("r").isNotNull())


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("r").isNull()).select("chunk_id", "doc_id", "ordinal", "response")


def valid_triples(rows: DataFrame, column: str) -> DataFrame:
    """Head, relation and tail of rows with at least three parts; further parts are cut."""
    parts = F.col(column)
    return rows.where(F.size(parts) >= 3).select(
        *[c for c in rows.columns if c != column], parts[0].alias("h"), parts[1].alias("r"), parts[2].alias("t")
    )


def _seq(phase: int, i: str, j: Column) -> Column:
    return F.struct(
        "doc_id", "ordinal", F.lit(phase).alias("phase"), F.col(i).alias("i"), j.cast("int").alias("j")
    ).alias("seq")


def attribute_rows(parsed: DataFrame) -> DataFrame:
    """(seq, chunk_id, entity, attribute, type): one row per attribute occurrence."""
    typed = F.transform(
        F.map_entries("r.attributes"),
        lambda e: F.struct(
            e["key"].alias("entity"), e["value"].alias("values"), F.try_element_at("r.entity_types", e["key"]).alias("type")
        ),
    )
    entries = parsed.select("doc_id", "ordinal", "chunk_id", F.posexplode_outer(typed).alias("i", "e"))
    flat = entries.select(
        "doc_id", "ordinal", "chunk_id", "i", "e.entity", "e.type", F.posexplode_outer("e.values").alias("j", "attribute")
    )
    return flat.where(F.col("j").isNotNull()).select(_seq(0, "i", F.col("j")), "chunk_id", "entity", "attribute", "type")


def triple_rows(parsed: DataFrame) -> DataFrame:
    """(seq, chunk_id, h, r, t, h_type, t_type): one row per valid triple."""
    kind = lambda name: F.try_element_at("r.entity_types", name)
    typed = F.transform(
        "r.triples",
        lambda p: F.struct(
            p.alias("parts"), kind(F.get(p, F.lit(0))).alias("h_type"), kind(F.get(p, F.lit(2))).alias("t_type")
        ),
    )
    rows = parsed.select("doc_id", "ordinal", "chunk_id", F.posexplode_outer(typed).alias("i", "e"))
    rows = rows.where(F.col("i").isNotNull()).select(
        "doc_id", "ordinal", "chunk_id", "i", "e.parts", "e.h_type", "e.t_type"
    )
    return valid_triples(rows, "parts").select(
        _seq(1, "i", F.lit(0)), "chunk_id", "h", "r", "t", "h_type", "t_type"
    )


def entities(attributes: DataFrame, triples: DataFrame) -> DataFrame:
    """Entity nodes by exact name; the first mention gives chunk and type."""
    later = F.col("seq").withField("j", F.lit(1))
    mentions = (
        attributes.select("seq", F.col("entity").alias("name"), "chunk_id", "type")
        .unionByName(triples.select("seq", F.col("h").alias("name"), "chunk_id", F.col("h_type").alias("type")))
        .unionByName(triples.select(later.alias("seq"), F.col("t").alias("name"), "chunk_id", F.col("t_type").alias("type")))
    )
    first = first_per_key(mentions, ["name"], ["seq"])
    return first.select(
        key_of(F.lit("entity"), F.col("name")).alias("node_id"),
        F.lit("entity").alias("label"),
        F.lit(2).alias("level"),
        "name",
        F.nullif(F.col("type"), F.lit("")).alias("schema_type"),
        "chunk_id",
    )


def _attribute_id() -> Column:
    return key_of(F.lit("attribute"), F.col("chunk_id"), F.col("entity"), F.col("seq.i"), F.col("seq.j"))


def attribute_nodes(attributes: DataFrame) -> DataFrame:
    """One node per occurrence; equal attribute texts are not unified while building."""
    return attributes.select(
        _attribute_id().alias("node_id"),
        F.lit("attribute").alias("label"),
        F.lit(1).alias("level"),
        F.col("attribute").alias("name"),
        F.lit(None).cast("string").alias("schema_type"),
        "chunk_id",
    )


def attribute_edges(attributes: DataFrame) -> DataFrame:
    return attributes.select(
        "seq",
        key_of(F.lit("entity"), F.col("entity")).alias("src"),
        F.lit("has_attribute").alias("relation"),
        _attribute_id().alias("dst"),
    )


def entity_edges(triples: DataFrame) -> DataFrame:
    return triples.select(
        "seq",
        key_of(F.lit("entity"), F.col("h")).alias("src"),
        F.col("r").alias("relation"),
        key_of(F.lit("entity"), F.col("t")).alias("dst"),
    )


def unique_edges(edges: DataFrame) -> DataFrame:
    """First edge of every (src, dst, relation)."""
    return first_per_key(edges, ["src", "dst", "relation"], ["seq"])


def to_graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed responses, edges without duplicates."""
    attributes, triples = attribute_rows(parsed), triple_rows(parsed)
    nodes = entities(attributes, triples).unionByName(attribute_nodes(attributes))
    return nodes, unique_edges(attribute_edges(attributes).unionByName(entity_edges(triples)))


def relationships(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per edge with label, name and type of both ends; isolated nodes do not appear."""
    side = lambda p, key: nodes.select(
        F.col("node_id").alias(key), F.col("label").alias(f"{p}_label"), F.col("name").alias(f"{p}_name"),
        F.col("schema_type").alias(f"{p}_type"),
    )
    return (
        edges.join(side("s", "src"), "src")
        .join(side("t", "dst"), "dst")
        .select("seq", "s_label", "s_name", "s_type", "relation", "t_label", "t_name", "t_type")
    )


def build_counts(parsed: DataFrame) -> DataFrame:
    """Chunks that gave a graph and chunks that failed, per document."""
    return parsed.groupBy("doc_id").agg(
        F.count_if(F.col("r").isNotNull()).alias("succeeded"), F.count_if(F.col("r").isNull()).alias("failed")
    )


def evolve_schema(current: DataFrame, proposals: DataFrame) -> DataFrame:
    """Append proposed (kind, name) types that are not in the schema, in order of first proposal."""
    first = first_per_key(proposals.select("kind", "name", "seq"), ["kind", "name"], ["seq"])
    new = first.join(current, ["kind", "name"], "left_anti")
    seq_type = proposals.schema["seq"].dataType
    old = current.select("kind", "name", F.lit(None).cast(seq_type).alias("seq"))
    return old.select("kind", "name", "seq", F.lit(False).alias("is_new")).unionByName(
        new.select("kind", "name", "seq", F.lit(True).alias("is_new"))
    )


def proposed_types(parsed: DataFrame) -> DataFrame:
    """(kind, name, seq) of the new types that responses suggest."""
    parts = [
        accepted(parsed).select(
            F.lit(kind).alias("kind"), "doc_id", "ordinal", F.posexplode(f"r.new_schema_types.{kind}").alias("i", "name")
        )
        for kind in ("nodes", "relations", "attributes")
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("kind", "name", F.struct("doc_id", "ordinal", "i").alias("seq"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def first_relations(edges: DataFrame) -> DataFrame:
    """First relation of every ordered pair of nodes."""
    return edges.groupBy("src", "dst").agg(F.min_by("relation", "seq").alias("relation"))


def triple_strings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, txt): distinct ``name relation name`` over out-neighbours, the name if none.

    Rows, not one text per node: a hub may have any number of neighbours.
    """
    names = nodes.select("node_id", "name")
    out = (
        first_relations(edges)
        .join(names.select(F.col("node_id").alias("src"), F.col("name").alias("h")), "src")
        .join(names.select(F.col("node_id").alias("dst"), F.col("name").alias("t")), "dst")
        .select(F.col("src").alias("node_id"), F.concat_ws(" ", "h", "relation", "t").alias("txt"))
        .distinct()
    )
    lonely = names.join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    return out.unionByName(lonely.select("node_id", F.col("name").alias("txt")))


def hashed_terms(strings: DataFrame, dim: int = 64) -> DataFrame:
    """(node_id, bucket, n): word counts by hash bucket, a test stand-in for an embedding model.

    Counts add up, so a hub's strings are combined before the shuffle.
    """
    words = strings.select("node_id", F.explode(F.split(F.lower("txt"), " ")).alias("w")).where(F.col("w") != "")
    bucket = F.conv(F.substring(F.md5("w"), 1, 4), 16, 10).cast("long") % dim
    return words.groupBy("node_id", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def hashed_vectors(terms: DataFrame, dim: int = 64) -> DataFrame:
    """(id, emb): unit vectors of hashed counts; a row holds at most ``dim`` buckets."""
    packed = terms.groupBy("node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", F.col("n").cast("double")))).alias("m"),
        F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"),
    )

    def slots(row: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda i: (F.coalesce(F.try_element_at(row["m"], i.cast("long")), F.lit(0.0)) / row["norm"]).cast("float"),
        )

    # bound, as the optimizer puts the aggregate's result into the inner function, which would build the map per slot
    return packed.select(F.col("node_id").alias("id"), bound(F.struct("m", "norm"), slots).alias("emb"))
