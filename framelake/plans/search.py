"""Searches: each builds one lazy plan of filters, exact ranking, boosts and backfill."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosts, filters
from ..operators.ranking import backfill, rank_vectors, ranks, reciprocal_rank_fusion, top_k
from ..operators.relations import by_relations
from ..operators.sequence import carry
from ..operators.temporal import chain_best, wide_picks, within
from .planner import Plan, QueryGraph, StepLog, merged_groups

POOL = 200


@dataclass
class Library:
    """The tables that searches read; vectors by space."""

    frames: DataFrame
    vectors: Mapping[str, DataFrame]
    objects: DataFrame | None = None
    videos: DataFrame | None = None
    lines: DataFrame | None = None
    speech: DataFrame | None = None
    fps: DataFrame | None = None
    region_vectors: DataFrame | None = None
    edges: DataFrame | None = None


@dataclass
class Filters:
    authors: Sequence[str] = ()
    date_from: str | None = None
    date_to: str | None = None
    keywords_any: Sequence[str] = ()
    groups: Sequence[tuple[tuple[str, ...], int]] = ()
    texts: Sequence[str] = ()
    boxes: Sequence[dict] = ()
    box_op: str = "and"
    relations: Sequence[tuple[str, str | None, str | None]] = ()
    #: Groups of labels none of which a frame may have.
    without: Sequence[Sequence[str]] = ()

    def joined(self, other: Filters) -> Filters:
        """Both filters: groups with the greater count, all texts, all boxes."""
        return Filters(
            self.authors or other.authors, self.date_from or other.date_from, self.date_to or other.date_to, tuple(self.keywords_any) or tuple(other.keywords_any),
            merged_groups(self.groups, other.groups), [*self.texts, *other.texts], [*self.boxes, *other.boxes], other.box_op if other.boxes else self.box_op, [*self.relations, *other.relations],
            [*self.without, *other.without],
        )


def candidates(lib: Library, f: Filters) -> DataFrame | None:
    """The frames that pass all hard filters, or None where nothing is asked."""
    videos = filters.by_metadata(lib.videos, f.authors, f.date_from, f.date_to, f.keywords_any) if lib.videos is not None else None
    keys = [filters.by_label_groups(lib.objects, f.groups) if f.groups else None]
    keys += [filters.by_text(lib.lines, t) for t in f.texts if t]
    keys.append(filters.by_drawn_boxes(lib.objects, lib.lines, f.boxes, f.box_op) if f.boxes else None)
    found = filters.combine(lib.frames, videos, keys)
    if f.relations:
        found = by_relations(lib.frames.select(*filters.KEY) if found is None else found, lib.edges, f.relations)
    for labels in f.without:
        has = filters.by_label_groups(lib.objects, [(tuple(labels), 1)])
        found = (lib.frames.select(*filters.KEY) if found is None else found).join(has, filters.KEY, "left_anti")
    return found


def ranked(lib: Library, queries: Mapping[str, Sequence[float]], k: int, keys: DataFrame | None, pool: int = POOL) -> DataFrame:
    """One space: exact top-k; several: their top pools fused by reciprocal ranks."""
    if len(queries) == 1:
        ((space, q),) = queries.items()
        return rank_vectors(lib.vectors[space], q, k, keys).select(*filters.KEY, "score")
    pools = [rank_vectors(lib.vectors[s], q, max(pool, k), keys).select(*filters.KEY, "score") for s, q in queries.items()]
    return reciprocal_rank_fusion(pools, k)


def search(
    lib: Library, queries: Mapping[str, Sequence[float]], k: int = 100, f: Filters | None = None, mentions: Sequence[str] = (), secondary: Sequence[Sequence[str]] = (),
    attributes: Sequence[tuple[Sequence[str], Sequence[float]]] = (), agreement: bool = False, with_backfill: bool = True, log: StepLog | None = None,
) -> DataFrame:
    """Frames for a sentence: hard filters, exact ranking of what passes, boosts over a pool of 4k, the best k, backfill up to k.

    queries: a vector for each space. Rows that don't pass the filters only
    come as backfill, marked and behind the others.
    """
    f = f or Filters()
    keys = candidates(lib, f)
    regions = [b for b in f.boxes if b.get("region") is not None]
    wide = bool(regions or mentions or secondary or attributes or agreement)
    result = ranked(lib, queries, 4 * k if wide else k, keys)
    if regions:
        parts = [
            boosts.text_position_signal(lib.lines, b.get("text", ""), b["region"]) if b["type"] == "ocr" else boosts.position_signal(lib.objects, b.get("labels") or (), b["region"])
            for b in regions
        ]
        result = boosts.boosted(result, boosts.mean_signal(parts), "position", boosts.POSITION)
    if mentions:
        result = boosts.boosted(result, boosts.clipped_sum([boosts.spoken_signal(result, lib.speech, t, lib.fps) for t in mentions]), "audio", boosts.AUDIO)
    if attributes:
        parts = [boosts.region_signal(lib.objects, lib.region_vectors, labels, vector) for labels, vector in attributes]
        result = boosts.boosted(result, boosts.mean_signal(parts), "region", boosts.REGION)
    if secondary:
        result = boosts.boosted(result, boosts.mean_signal([boosts.secondary_signal(lib.objects, labels) for labels in secondary]), "secondary", boosts.SECONDARY)
    if agreement:
        result = boosts.boosted(result, boosts.agreement_signal(result, lib.lines, lib.speech), "agreement", boosts.AGREEMENT)
    if log:
        log.note("plan", f"filters={keys is not None}, pool={4 * k if wide else k}")
    if keys is None or not with_backfill:
        return top_k(result, k).withColumn("is_backfill", F.lit(False))
    return backfill(result, ranked(lib, queries, k, None), k)


def search_plan(lib: Library, plan: Plan, encode: Callable[[str], Mapping[str, Sequence[float]]], labels_of: Callable[[str], Sequence[str]], k: int = 100, f: Filters | None = None, encode_region: Callable[[str], Sequence[float]] | None = None) -> DataFrame:
    """A sentence's plan as a search: entities filter; mentions, secondary entities and attributes boost."""
    secondary = [labels for s in plan.secondary_entities if (labels := labels_of(s["term"]))]
    attributes = [(labels, encode_region(a["attribute_text"])) for a in plan.attributes if encode_region and (labels := labels_of(a["entity_term"]))]
    own = Filters(groups=plan.groups)
    return search(lib, encode(plan.clip_text), k, own if f is None else own.joined(f), [m["term"] for m in plan.audio_mentions if m.get("term")], secondary, attributes)


@dataclass
class Anchor:
    """A moment of a chain: vectors of its text, and filters of its own."""

    queries: Mapping[str, Sequence[float]]
    filters: Filters = field(default_factory=Filters)

    @staticmethod
    def of(said: str | Mapping | Anchor, encode: Callable[[str], Mapping[str, Sequence[float]]]) -> Anchor:
        """An anchor from a sentence, or from a mapping with ``text`` and any fields of Filters."""
        if isinstance(said, Anchor):
            return said
        if isinstance(said, str):
            return Anchor(encode(said))
        return Anchor(encode(said["text"]), Filters(**{k: v for k, v in said.items() if k != "text"}))


def search_temporal(lib: Library, anchors: Sequence[Anchor], k: int = 100, f: Filters | None = None, pool: int = 1000, aggregate: str = "min", backfilled: bool = False) -> DataFrame:
    """Per video the best frames in strict order, one for each anchor; at least two anchors. Backfill stays out of the pools unless asked for."""
    if len(anchors) < 2:
        raise ValueError("a chain needs at least two anchors")
    f = f or Filters()
    pools = [search(lib, a.queries, pool, f.joined(a.filters), with_backfill=backfilled) for a in anchors]
    return wide_picks(chain_best(pools, aggregate, k), len(anchors), lib.fps)


def speech_context(results: DataFrame, speech: DataFrame, margin: int) -> DataFrame:
    """context: what is said within ``margin`` frames of each result, in order; null where nothing is."""
    near = within(results.select(*filters.KEY).distinct(), speech, margin).groupBy(*filters.KEY)
    said = near.agg(F.array_sort(F.collect_list(F.struct("frame_idx_start", "text_raw"))).alias("said"))
    context = said.select(*filters.KEY, F.array_join(F.transform("said", lambda x: x["text_raw"]), " ").alias("context"))
    return results.join(context, filters.KEY, "left")


def answer_question(results: DataFrame, speech: DataFrame | None, ask: Callable[[DataFrame], DataFrame], n: int = 5, margin: int = 75, which: str = "last") -> DataFrame:
    """(rank, video_id, frame_id, answer): the first n results are put to a model with what is said round them; later ranks carry an answer on."""
    order = F.struct(F.coalesce("is_backfill", F.lit(False)).alias("b"), (-F.col("score")).alias("s")) if "is_backfill" in results.columns else F.struct((-F.col("score")).alias("s"))
    placed = ranks(results.withColumn("_o", order).withColumn("_neg", F.lit(0)), score="_neg", key=("_o", *filters.KEY)).drop("_o", "_neg")
    asked = placed.where(F.col("rank") <= n)
    asked = speech_context(asked, speech, margin) if speech is not None else asked.withColumn("context", F.lit(None).cast("string"))
    answers = ask(asked).select("rank", "answer")
    full = placed.join(answers, "rank", "left")
    return carry(full, "answer", ["rank"], which=which).select("rank", "video_id", F.col("frame_idx").alias("frame_id"), "answer")


def run_graph(
    lib: Library, graph: QueryGraph, encode: Callable[[str], Mapping[str, Sequence[float]]], k: int = 100, pool: int = 1000, budget: int = 400,
    check_edge: Callable[[DataFrame, object], DataFrame] | None = None, most_checked: int = 15, seconds: float | None = None, log: StepLog | None = None,
) -> tuple[DataFrame, list]:
    """A graph's scenes, counts and spatial edges as filters on a pool; semantic edges are checked on a short list, or returned as unverified.

    A checked edge gives (key, edge_score); a frame's score is the least of its
    own and its edges'. Where ``seconds`` have gone by before an edge's turn, it
    and those after it stay unverified.
    """
    log = log or StepLog()
    label, kinds = graph.labels(), graph.edges_by_kind()
    f = Filters(
        groups=[((n.label,), n.count) for n in graph.nodes_where(lambda n: n.label and n.count > 1)],
        relations=[(e.relation, label.get(e.src), label.get(e.dst)) for e in kinds.get("spatial", [])],
    )
    text = " ".join(n.scene for n in graph.nodes_where(lambda n: n.scene))
    short = log.run("pool", lambda: top_k(search(lib, encode(text), pool, f, with_backfill=False), budget))
    asked = list(kinds.get("semantic", []))
    if asked and (check_edge is None or log.run("size", lambda: short.limit(most_checked + 1).count()) > most_checked):
        return top_k(short, k), asked
    while asked and (seconds is None or log.seconds() < seconds):
        edge = asked.pop(0)
        scores = log.run(f"edge {edge.relation}", lambda e=edge: check_edge(short, e)).select(*filters.KEY, "edge_score")
        short = short.join(scores, filters.KEY, "left").withColumn("score", F.least("score", F.coalesce("edge_score", F.lit(0.0)))).drop("edge_score")
    return top_k(short, k), asked
