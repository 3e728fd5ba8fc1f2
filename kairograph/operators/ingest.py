"""Ingest: what an utterance says, taken into the graph.

The text and its segments are embedded, candidates are gathered, and an extractor turns them into operations.  If its
first answer repeats stored nodes that it was not shown, leaves created nodes without an edge or uses unknown edge types,
it is asked once more.  The batch is checked and applied.  The embedder and the extractor are given from outside:
embed(texts) returns a vector for each text, extract(request) a Batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.config import EngineConfig, InvalidRequest, UnlinkedNode, UpstreamError
from kairograph.functions.text import segments
from kairograph.functions.time import local_iso
from kairograph.operators import candidates as C
from kairograph.operators import mutations, reads, validation
from kairograph.operators.recall import vector
from kairograph.sources.graph import Graph, cut


def read_prompt(*paths: str) -> str:
    """What an extractor is told beforehand: the files one after another, a rule between them."""
    texts = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            texts.append(f.read())
    return "\n---\n\n".join(texts)


def with_retry(call: Callable[[], Any], attempts: int = 3, backoff: tuple[float, ...] = (0.5, 1.0, 2.0), sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls again after a failure that may pass: no answer, or a status of 500 and more."""
    for attempt in range(attempts):
        try:
            return call()
        except UpstreamError as e:
            if attempt == attempts - 1 or e.answered is not None and e.answered < 500:
                raise
            sleep(backoff[min(attempt, len(backoff) - 1)])
    raise UpstreamError("no attempt was made")


def embed_all(embed: Callable[[list[str]], list[list[float]]], texts: list[str], dimension: int, batch: int = 64, **retry) -> list[list[float]]:
    """A vector for each text, asked for in batches; raises if one is missing or of another width."""
    out: list[list[float]] = []
    for k in range(0, len(texts), batch):
        part = texts[k : k + batch]
        found = with_retry(lambda part=part: embed(part), **retry)
        if len(found) != len(part) or any(len(v) != dimension for v in found):
            raise UpstreamError(f"the embedder gave {len(found)} vectors for {len(part)} texts, or one that is not {dimension} wide")
        out += found
    return out


@dataclass
class Batch:
    """Tables of operations, see mutations; closed_nodes has evidence beside id."""

    creates: DataFrame | None = None
    edges: DataFrame | None = None
    patches: DataFrame | None = None
    spawns: DataFrame | None = None
    session_edits: DataFrame | None = None
    closed_nodes: DataFrame | None = None
    closed_edges: DataFrame | None = None
    noops: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}


@dataclass
class Request:
    """What an extractor is given.  recheck names the first of what was wrong with its first answer; loose (rows of its
    creates without an edge) and odd_types (type) are all of it."""

    text: str
    source_text: str | None
    occurred_at: str
    nodes: DataFrame
    edges: DataFrame
    recheck: str | None
    loose: DataFrame | None = None
    odd_types: DataFrame | None = None


def validate(graph: Graph, batch: Batch, text: str, source_text: str | None, zone: str) -> None:
    """Raises for a broken rule, a closing that quotes nothing, or a created node without an edge."""
    b = batch
    validation.require_valid(validation.violations(graph, zone, creates_=b.creates, edges_=b.edges, patches_=b.patches, spawns_=b.spawns, session_edits_=b.session_edits, closed_nodes=b.closed_nodes, closed_edges=b.closed_edges, noops=b.noops))
    if b.closed_nodes is not None:
        said = F.lit(text if source_text is None else f"{text}\n{source_text}")
        bad = C.evidence_failures(b.closed_nodes, said).select("id").first()
        if bad is not None:
            raise InvalidRequest(f"close_node {bad.id}: the evidence is no quotation")
    if b.creates is not None:
        loose = C.named(C.unlinked(b.creates, b.edges, b.spawns), "title")
        if loose:
            raise UnlinkedNode(f"created nodes have no edge: {loose}")


def ingest(
    graph: Graph, text: str, embed: Callable, extract: Callable[[Request], Batch], *, occurred_at: str, at: Column, zone: str, writer: str, config: EngineConfig,
    participants: tuple[str, ...] = (), source_text: str | None = None,
) -> mutations.Applied:
    """The graph after the utterance, with what was done."""
    spark = graph.nodes.sparkSession
    one = spark.range(1).select(segments(F.lit(text), config.segment_limit).alias("s"), local_iso(F.lit(occurred_at).cast("timestamp"), zone).alias("at")).first()
    vectors = [vector(v) for v in embed_all(embed, [text, *one.s], config.dimension, config.embed_batch)]

    def ask(extra, recheck: str | None, loose: DataFrame | None = None, odd: DataFrame | None = None) -> tuple[DataFrame, Batch]:
        ids = cut(C.candidates(graph, text, vectors, writer, extra, at, config, participants))
        shown = reads.live_nodes(graph, at).join(ids, "id", "left_semi")
        chosen = C.context_edges(graph, ids, config.edge_context_limit).select("id")
        return ids, with_retry(lambda: extract(Request(text, source_text, one.at, shown, graph.edges.join(chosen, "id", "left_semi"), recheck, loose, odd)))

    ids, batch = ask([], None)
    missed = None if batch.creates is None else cut(C.lookalikes(graph, C.news_of(batch.creates, batch.edges), at, zone, ids).select("id").distinct())
    loose = None if batch.creates is None else C.unlinked(batch.creates, batch.edges, batch.spawns)
    odd = None if batch.edges is None else C.unknown_edge_types(batch.edges)
    notes = C.recheck_reasons(missed, loose, odd)
    if notes:
        _, batch = ask([] if missed is None else missed, " ".join(notes), loose, odd)
    validate(graph, batch, text, source_text, zone)
    b = batch
    creates = b.creates
    if creates is not None:
        creates = with_vectors(creates.withColumn("agent_id", mutations.value_of(creates, "agent_id", "string")).fillna({"agent_id": writer}), embed, config)
    return mutations.apply(graph, at, zone, creates=creates, spawns=b.spawns, patches=b.patches, edges=b.edges, closed_edges=b.closed_edges, closed_nodes=b.closed_nodes, session_edits=b.session_edits, noops=b.noops)


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], config: EngineConfig, **retry) -> DataFrame:
    """(key, embedding) of the texts (key, text): each task asks for its own, in batches, with retries.

    embed goes to the tasks, so it must be a function that can be sent."""
    size, dimension = config.embed_batch, config.dimension

    def run(batches):
        for batch in batches:
            vectors = embed_all(embed, ["" if t is None else t for t in batch.column("text").to_pylist()], dimension, size, **retry)
            yield pa.record_batch([batch.column("key"), pa.array(vectors, pa.list_(pa.float32()))], ["key", "embedding"])

    return texts.select("key", "text").mapInArrow(run, "key string, embedding array<float>")


def with_vectors(creates: DataFrame, embed: Callable, config: EngineConfig) -> DataFrame:
    """Created nodes with their vectors, asked for once and stored."""
    found = cut(embedded(mutations.embedding_requests(None, creates), embed, config))
    return creates.drop("embedding").join(found.select(F.expr("substring(key, length('create:') + 1)").alias("temp_id"), "embedding"), "temp_id", "left")
