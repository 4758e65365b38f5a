"""Dictionaries of terms: merging by priority, resolving terms to labels, finding known terms in a sentence."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize


def priority_union(dictionaries: Sequence[tuple[int, DataFrame]]) -> DataFrame:
    """(term_norm, label, priority) from (term, label) tables: for each term the entry of the smallest priority, then the smallest label."""
    rows = None
    for priority, d in dictionaries:
        part = d.select(normalize(F.col("term")).alias("term_norm"), "label", F.lit(priority).alias("priority")).where("term_norm <> ''")
        rows = part if rows is None else rows.unionByName(part)
    place = F.row_number().over(Window.partitionBy("term_norm").orderBy("priority", "label"))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def resolve(terms: DataFrame, dictionary: DataFrame, term: str = "term") -> DataFrame:
    """(term, label): the exact entry; else the labels with most entries that contain the term, or that it contains, as whole words.

    Part matches need three characters of the term and four of the entry. The
    second step joins on single words, which both sides are cut into, so it
    isn't a cross join.
    """
    asked = terms.select(F.col(term).alias("term"), normalize(F.col(term)).alias("q")).where("q <> ''").distinct()
    exact = asked.join(dictionary, asked["q"] == dictionary["term_norm"]).select("term", "label")
    rest = asked.join(exact, "term", "left_anti").where(F.length("q") >= 3)
    entries = dictionary.where(F.length("term_norm") >= 4).select("term_norm", "label")
    by_word = rest.withColumn("w", F.explode(F.array_distinct(F.split("q", " ")))).join(entries.withColumn("w", F.explode(F.array_distinct(F.split("term_norm", " ")))), "w")
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    hits = by_word.where(F.contains(pad("term_norm"), pad("q")) | F.contains(pad("q"), pad("term_norm"))).select("term", "term_norm", "label").distinct()
    votes = hits.groupBy("term", "label").agg(F.count("*").alias("n"))
    best = votes.withColumn("most", F.max("n").over(Window.partitionBy("term"))).where("n = most").select("term", "label")
    return exact.unionByName(best)


def find_known_terms(sentence: str, entries: dict[str, str], least: int = 3) -> dict[str, str]:
    """Entries that occur in a normalised sentence as whole words, longest first (then leftmost), without overlaps.

    Only windows of words that are entries are looked at, so the cost is that
    of the sentence, not of the dictionary.
    """
    words = sentence.split()
    longest = max((k.count(" ") + 1 for k in entries), default=0)
    found = []
    for i in range(len(words)):
        for n in range(1, min(longest, len(words) - i) + 1):
            phrase = " ".join(words[i : i + n])
            if len(phrase) >= least and phrase in entries:
                found.append((-len(phrase), i, n, phrase))
    taken: set[int] = set()
    hits = {}
    for _, i, n, phrase in sorted(found):
        place = set(range(i, i + n))
        if not place & taken:
            taken |= place
            hits[phrase] = entries[phrase]
    return hits


def known_terms(sentences: DataFrame, entries: dict[str, str], key: str, text: str) -> DataFrame:
    """(key, term, label, place) for each sentence; the dictionary (thousands of entries) is broadcast."""
    held = sentences.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, terms, labels = [], [], []
            for k, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for term, label in find_known_terms(t or "", held.value).items():
                    keys.append(k)
                    terms.append(term)
                    labels.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("k").type), pa.array(terms, pa.string()), pa.array(labels, pa.string())], names=[key, "term", "label"])

    kind = sentences.schema[key].dataType.simpleString()
    return sentences.select(F.col(key).alias("k"), normalize(F.col(text)).alias("t")).mapInArrow(run, f"{key} {kind}, term string, label string")


def valid_synonyms(candidates: DataFrame, canonical: DataFrame) -> DataFrame:
    """(label, synonym) that neither contains another label's canonical name nor is claimed by several labels, unless it is the label's own name.

    Synonyms are short: their stretches that are as long as some name meet the
    names by equality, so nothing is broadcast and no pairs are tried.
    """
    own = canonical.select(F.col("label").alias("c_label"), normalize(F.col("name")).alias("c_name")).where("c_name <> ''")
    rows = candidates.select("label", "synonym", normalize(F.col("synonym")).alias("s"))
    lengths = sorted(r[0] for r in own.select(F.length("c_name")).distinct().collect())  # a number for each length of a name
    starts = lambda n: F.transform(F.when(F.length("s") >= n, F.sequence(F.lit(1), F.length("s") - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.substring(F.col("s"), i, F.lit(n)))
    parts = F.array_distinct(F.concat(*[starts(n) for n in lengths])) if lengths else F.array().cast("array<string>")
    held = rows.select("s", "label").distinct().withColumn("c_name", F.explode(parts)).join(own, "c_name").where("c_label <> label").select("s", "label").distinct()
    other = rows.join(held, ["s", "label"], "left_anti")
    owners = other.select("s", "label").distinct().groupBy("s").agg(F.count("*").alias("owners"))
    judged = other.join(owners, "s").join(own, F.col("label") == F.col("c_label"), "left")
    return judged.where((F.col("owners") <= 1) | (F.col("s") == F.col("c_name"))).select("label", "synonym")


def suggest(label_vectors: DataFrame, query, k: int = 5) -> DataFrame:
    """The k labels whose vectors are nearest to the query's."""
    from .ranking import rank_vectors

    return rank_vectors(label_vectors, query, k, key=("label",))


def missing(labels: DataFrame, done: DataFrame, key: str = "label") -> DataFrame:
    """Labels that have no entry yet."""
    return labels.join(done, key, "left_anti")
