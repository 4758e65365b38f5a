"""Plans of a query: what its sentence asks for, and graphs of events. All of this is driver code on one sentence."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from ..operators.dictionary import find_known_terms
from ..operators.temporal import linear_chain

T = TypeVar("T")

# Body parts that are never a hard filter, and words for numbers.
BODY_PARTS = frozenset({
    "Human arm", "Human beard", "Human ear", "Human eye", "Human face", "Human foot",
    "Human hair", "Human hand", "Human head", "Human leg", "Human mouth", "Human nose",
})
QUANTITIES = {
    "một": 1, "1": 1, "hai": 2, "2": 2, "đôi": 2, "cặp": 2, "ba": 3, "3": 3, "bốn": 4, "4": 4, "năm": 5, "5": 5, "nhiều": 2, "vài": 2, "một vài": 2, "một số": 2,
    "one": 1, "a": 1, "an": 1, "two": 2, "three": 3, "four": 4, "five": 5, "many": 2, "several": 2, "some": 2,
}


@dataclass
class Plan:
    """What a sentence asks for; groups are alternatives of labels with a count, and every group has to be met."""

    clip_text: str
    entities: list[dict] = field(default_factory=list)
    secondary_entities: list[dict] = field(default_factory=list)
    attributes: list[dict] = field(default_factory=list)
    audio_mentions: list[dict] = field(default_factory=list)
    groups: list[tuple[tuple[str, ...], int]] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)


def normalized(text: str) -> str:
    import unicodedata

    return " ".join(unicodedata.normalize("NFC", text).lower().split())


def rule_based(sentence: str, entries: Mapping[str, str]) -> Plan:
    """Known terms as entities, each with the number word before it; what stands in quotes after a verb of saying is heard."""
    text = normalized(re.sub(r"[.,;:!?]", " ", sentence))
    plan = Plan(clip_text=sentence)
    for term in sorted(find_known_terms(text, dict(entries)), key=lambda t: f" {text} ".find(f" {t} ")):
        at = f" {text} ".find(f" {term} ")
        before = text[:at].split()
        named = [QUANTITIES[n] for n in (" ".join(before[-2:]), " ".join(before[-1:])) if n in QUANTITIES]
        plan.entities.append({"term": term, "min_count": named[0] if named else 1})
    for said in re.findall(r"(?:nhắc (?:tới|đến)|nói|says?|mentions?)\s+[\"“]([^\"”]+)[\"”]", sentence):
        plan.audio_mentions.append({"term": normalized(said)})
    return plan


def from_model(answer: str, sentence: str) -> Plan:
    """A model's JSON answer as a plan; what can't be read gives a plan of the sentence alone."""
    bare = re.sub(r"^\s*```(?:json)?|```\s*$", "", answer.strip()).strip()
    try:
        said = json.loads(bare)
        known = {k: [x for x in said.get(k) or [] if isinstance(x, dict)] for k in ("entities", "secondary_entities", "attributes", "audio_mentions")}
        return Plan(clip_text=said.get("clip_text") or sentence, **known)
    except (ValueError, AttributeError):
        return Plan(clip_text=sentence)


def resolve_term(term: str, entries: Mapping[str, str]) -> list[str]:
    """A term's labels: its own entry; else the labels most of whose entries contain it, or are contained in it, as whole words."""
    q = normalized(term)
    if q in entries:
        return [entries[q]]
    if len(q) < 3:
        return []
    votes: dict[str, int] = {}
    for entry, label in entries.items():
        if len(entry) >= 4 and (f" {q} " in f" {entry} " or f" {entry} " in f" {q} "):
            votes[label] = votes.get(label, 0) + 1
    most = max(votes.values(), default=0)
    return sorted(k for k, n in votes.items() if n == most)


def resolved(plan: Plan, entries: Mapping[str, str]) -> Plan:
    """Entities as groups of labels; body parts become secondary, unknown terms are listed."""
    for entity in plan.entities:
        term, count = entity["term"], entity.get("min_count") or 1
        labels = resolve_term(term, entries)
        if not labels:
            plan.unresolved.append(term)
        elif BODY_PARTS & set(labels):
            if term not in {s["term"] for s in plan.secondary_entities}:
                plan.secondary_entities.append({"term": term})
        else:
            plan.groups.append((tuple(labels), count))
    return plan


def distilled(sentence: str, entries: Mapping[str, str], model: Callable[[str, Mapping[str, str]], str] | None = None) -> str:
    """A short caption of a sentence by a model that is told the known terms in it; without one, or if it fails, the sentence."""
    if model is None:
        return sentence
    try:
        return model(sentence, find_known_terms(normalized(sentence), dict(entries))).strip() or sentence
    except Exception:  # a model call may fail in any way; the search goes on
        return sentence


def labels_in_order(labels: Iterable[str]) -> list[str]:
    return sorted(labels, key=normalized)


def merged_groups(*lists: Iterable[tuple[tuple[str, ...], int]]) -> list[tuple[tuple[str, ...], int]]:
    """Groups of several sources; of equal ones the greater count stands."""
    out: dict[tuple[str, ...], int] = {}
    for groups in lists:
        for labels, count in groups:
            out[labels] = max(out.get(labels, 1), count)
    return list(out.items())


@dataclass(frozen=True)
class Node:
    id: str
    label: str | None = None
    scene: str | None = None
    count: int = 1


@dataclass(frozen=True)
class Edge:
    src: str
    dst: str
    relation: str
    kind: str  # spatial, semantic or temporal


@dataclass
class QueryGraph:
    """Events, objects and how they relate: two small tables, and what searches ask of them."""

    nodes: list[Node]
    edges: list[Edge]

    def edges_by_kind(self) -> dict[str, list[Edge]]:
        """The edges of each kind that has any, in their order."""
        return {kind: [e for e in self.edges if e.kind == kind] for kind in dict.fromkeys(e.kind for e in self.edges)}

    def nodes_where(self, condition: Callable[[Node], object]) -> list[Node]:
        return list(filter(condition, self.nodes))

    def labels(self) -> dict[str, str | None]:
        """Label by node; of nodes with one id the first counts."""
        return {n.id: n.label for n in reversed(self.nodes)}

    def events(self) -> list[Node]:
        """The nodes that temporal edges put in order."""
        known = {n.id: n for n in self.nodes}
        before = [(e.src, e.dst) for e in self.edges_by_kind().get("temporal", [])]
        return [known[i] for i in linear_chain(before, list(known))]


@dataclass
class StepLog:
    """What a search did: (step, detail, seconds) in order; ``table`` gives it as rows."""

    rows: list[tuple[str, str, float]] = field(default_factory=list)
    now: Callable[[], float] = time.monotonic

    def note(self, step: str, detail: str = "", seconds: float = 0.0) -> None:
        self.rows.append((step, detail, seconds))

    def run(self, step: str, work: Callable[[], T], detail: Callable[[T], str] = lambda _: "") -> T:
        """``work``'s result; how long it took is noted, also where it fails."""
        start, told = self.now(), "failed"
        try:
            result = work()
            told = detail(result)
            return result
        finally:
            self.note(step, told, self.now() - start)

    def seconds(self) -> float:
        return sum(s for *_, s in self.rows)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], "place int, step string, detail string, seconds double")
