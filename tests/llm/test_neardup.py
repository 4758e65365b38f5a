import random
import re

import pytest

from framelake.llm.neardup import near_duplicates, needed_matches, shingle_set, signature

SCHEMA = "doc_id bigint, text string, component_id string, token int"


def sets(rows):
    out = []
    for _, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def brute(rows, percent=85):
    found = sets(rows)
    ids = [r[0] for r in rows]
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = found[i], found[j]
            if a and b and None not in (ids[i], ids[j]) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(ids[i]), top(ids[j])))
                root[y] = x
    return sorted((i, len(s), top(i) if i is not None else None, i is None or top(i) == i) for i, s in zip(ids, found, strict=True))


def run(spark, rows):
    return sorted(tuple(r) for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect())


def words(rng, n):
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa mu nu xi pi rho tau".split()) + str(rng.randint(0, 99)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_groups_chains_and_shared_passages(spark, seed):
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, rng.randint(5, 120))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = "changed" + str(rng.randint(0, 9))
            rows.append((n := n + 1, " ".join(text), "x", 1))
    for _ in range(15):  # most of these is one passage, but not enough
        rows.append((n := n + 1, " ".join(passage + words(rng, rng.randint(5, 40))), "x", 1))
    chain = words(rng, 200)
    for i in range(8):  # each is near the one before only
        chain = chain[12:] + words(rng, 12)
        rows.append((n := n + 1, " ".join(chain), "x", 1))
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = words(rng, 150)
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(len(text))] = f"own{i}"
        rows.append((1000 + i, " ".join(text), "x", 1))
    got = run(spark, rows)
    assert got == brute(rows)


def test_edges(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \t\n", "x", 1), (4, "one two", "x", 1), (5, "One  TWO\n", "x", 1), (6, "one two three", "x", 1)]
    rows += [(7, "Édouard a b c d e", "x", 1), (8, "édouard a b c d e", "x", 1), (9, "w " * 50_000, "x", 1), (10, "w " * 7, "x", 1), (None, "one two", "x", 1)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(brute(rows[:-1]) + [(None, 1, None, True)], key=str)
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows(spark):
    rows = [(3, "a b c d e f", "x", 1)] * 3 + [(2, "a b c d e f", "x", 1)]
    assert run(spark, rows) == [(2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (3, 2, 2, False)]


def test_signatures_keep_their_coordinate():
    s = signature(shingle_set("a b c d e f g"))
    assert [int(x) & 63 for x in s] == list(range(64))
    assert (signature(shingle_set("A b  c d e f g")) == s).all()


def test_lower_likeness_links_too(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):  # the shorter one is 81 of the 100 shingles of the longer one
        text = words(rng, 104)
        rows += [(2 * i, " ".join(text), "x", 1), (2 * i + 1, " ".join(text[:85]), "x", 1)]
    got = near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), percent=80).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i in range(24)]
    assert all(r.kept for r in near_duplicates(spark, spark.createDataFrame(rows, SCHEMA)).collect())


def test_matches_follow_the_likeness():
    assert (needed_matches(85), needed_matches(80), needed_matches(100)) == (40, 35, 64)
    with pytest.raises(ValueError):
        near_duplicates(None, None, percent=10)


def exact_components(rows, percent):
    """By an inverted index over all shingles: every pair that shares one is counted, none is estimated."""
    from collections import Counter, defaultdict

    found = dict(zip([r[0] for r in rows], sets(rows), strict=True))
    postings = defaultdict(list)
    for i, s in found.items():
        for x in s:
            postings[x].append(i)
    common = Counter((a, b) for own in postings.values() for k, a in enumerate(own) for b in own[k + 1 :])
    root = {i: i for i in found}

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = 0
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(found[a]) + len(found[b]) - n):
            links += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in found}, links


def test_against_an_exact_join(spark):
    """Pairs at exactly 0.85 and just below it, short texts, a passage that many share; all links of 6,000 texts against an index of all shingles."""
    import random

    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(40_000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(1500):
        long, short = [word() for _ in range(104)], [word() for _ in range(24)]
        texts += [long, long[:89], short, short[:21]]  # 85 of 100 and 17 of 20 shingles
        if k % 5 == 0:
            texts += [long[:88], long[:50] + passage + long[50:], [w.upper() for w in long]]  # 84 of 100; a shared passage; the same but for case
    rng.shuffle(texts)
    rows = [(i, " ".join(t), "s", 0) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark, frame).collect()}
    want, links = exact_components(rows, 85)
    assert links > 3500 and sum(got[i] != want[i] for i in want) == 0
