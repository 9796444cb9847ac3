"""Exact and near duplicates, repeated passages and leaks against brute force, with the awkward rows."""

import itertools
import random
import re

import pytest

from casetide.llm import components, decontam, exact_dedup, minhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, keep_id string, root string"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "s", "extra", "extra") for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_groups(spark):
    texts = ["a  b", "a\tb", "a b", "", None, "x"] + ["hot"] * 80 + [" "] * 3
    got = {r.doc_id: r for r in exact_dedup.exact_groups(frame(spark, texts), heavy_rows=10).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same), len(same), i == min(same))
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    twice = exact_dedup.exact_groups(frame(spark, ["a", "a", "a"], [1, 1, None])).collect()
    assert sorted((r.doc_id, r.kept) for r in twice if r.doc_id) == [(1, True), (1, True)]
    kept = exact_dedup.drop_exact_copies(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and kept.count() == len(set(norm))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)]
    want = reach({x for e in links for x in e}, links)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    loops = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {n: r for n, r in want.items() if n not in loops}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    texts = []
    for _ in range(12):
        base = words(rng, rng.choice([6, 12, 40, 200]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    texts += ["", None, "   ", "One", "one", "one two", "same text here now", "SAME text\there now"]
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reach(range(len(texts)), links)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), size=size).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}


def test_near_duplicates_of_odd_tables(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    out = minhash.near_duplicates(frame(spark, ["a b c", "a b c", "q", None], [None, 1, 1, 2])).collect()
    assert len(out) == 4 and [r.component_id for r in out if r.doc_id is None] == [None]
    assert minhash.drop_near_copies(frame(spark, ["a b c d e f", "a b c d e f", None])).count() == 2


def test_dissimilar_members_of_a_bucket_are_not_linked(spark):
    rng = random.Random(3)
    base = words(rng, 60)
    texts = []
    for k in range(30):  # chains: neighbours are similar, far ones aren't
        base = list(base)
        base[k] = f"new{k}"
        texts.append(" ".join(base))
    got = {r.component_id for r in minhash.near_duplicates(frame(spark, texts)).collect()}
    assert got == {0}


def test_passages(spark):
    rng = random.Random(5)
    passage = " ".join(words(rng, 60, 10**6))
    clean = [" ".join(words(rng, 150, 10**6)) for _ in range(10)]
    short = "just a few common words here"
    texts = [f"{c} {short}." for c in clean] + [f"{' '.join(words(rng, 40, 10**6))} {passage} {' '.join(words(rng, 30, 10**6))}" for _ in range(6)] + [None, ""]
    got = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    assert {r.doc_id for r in got} == set(range(11, 16)) and {r.keep_id for r in got} == {10}
    for r in got:
        span = texts[r.doc_id].encode()[r.byte_from : r.byte_to].decode().split()
        assert sum(w in passage.split() for w in span) >= 0.8 * len(span)  # a paragraph at the edge may hold a few words more
    left = {r.doc_id: r.text for r in substring_dedup.without_passages(frame(spark, texts)).collect()}
    assert left[10] == texts[10] and len(left[12]) < len(texts[12]) - 100 and left[16] is None
    assert substring_dedup.repeated_passages(frame(spark, [])).count() == 0


def test_every_exact_passage_over_50_words(spark):
    rng = random.Random(11)
    texts, planted = [], []
    for n in range(51, 61):
        for k in range(8):
            passage = " ".join(words(rng, n, 10**6))
            planted.append((len(texts) + 1, passage))
            texts += [" ".join([*words(rng, 7 * k, 10**6), passage, *words(rng, rng.randrange(70), 10**6)]) for _ in range(2)]
    texts += ["same " * 60, " ".join([passage, *words(rng, 9, 10**6), passage])]
    found = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    got = {r.doc_id: (texts[r.doc_id].encode()[r.byte_from : r.byte_to].decode(), r.words) for r in found}
    for i, p in planted:  # a near paragraph at the edge may hold a few words more
        assert p in got[i][0] and got[i][1] <= len(p.split()) + 8
    assert {r.doc_id for r in found} == {i for i, _ in planted} | {len(texts) - 1}
    again = [r.words for r in found if r.doc_id == len(texts) - 1]
    assert len(again) == 2 and all(60 <= n <= 68 for n in again)
    left = {r.doc_id: r.text for r in substring_dedup.without_passages(frame(spark, texts)).collect()}
    assert all(not set(p.split()) & set(left[i].split()) and left[i - 1] == texts[i - 1] for i, p in planted)


def test_tables_that_the_spans_do_not_read_are_deleted(spark):
    from pathlib import Path

    rng = random.Random(19)
    passage = " ".join(words(rng, 60, 10**6))
    near = [f"{passage} a{k}" for k in range(3)]
    texts = [*near, *[" ".join([*words(rng, 40, 10**6), passage]) for _ in range(3)], near[0]]
    substring_dedup.repeated_passages(frame(spark, [])).count()
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir())
    found = substring_dedup.repeated_passages(frame(spark, texts))
    assert {r.doc_id for r in found.collect()} == set(range(1, 7))
    assert {p.name for p in set(folder.iterdir()) - before} == {f.split("/")[-2] for f in found.inputFiles()} - {""}
    assert {r.doc_id for r in found.collect()} == set(range(1, 7))  # what it reads is still there


def test_near_paragraphs_of_usual_length(spark):
    rng = random.Random(13)
    texts = []
    for k in range(40):
        n, changes = ((60, 1), (100, 2))[k % 2]
        one = words(rng, n, 10**6)
        two = list(one)
        for c in range(changes):
            two[n // (changes + 1) * (c + 1)] = f"new{k}x{c}"
        if k % 4 > 1:  # over several lines
            one[20] += "\n"
            two[30] += "\n"
        texts += ["\n \n".join([" ".join(words(rng, 60, 10**6)), " ".join(p), " ".join(words(rng, 60, 10**6))]) for p in (one, two)]
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert got == set(range(1, 80, 2))


def test_similar_paragraphs_of_a_bucket_that_its_centre_is_unlike(spark):
    rng = random.Random(17)
    texts, phrase = [], words(rng, 5, 10**6)
    for _ in range(40):  # every shingle of the phrase is in every line, so that buckets are shared by all
        head, tail = words(rng, 3, 10**6), words(rng, 45, 10**6)
        for k in range(2):
            texts.append(" ".join([*(phrase * 5 + head), *tail[:44], f"end{k}", *tail[44:]]))
    got = {r.doc_id for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert got >= set(range(1, 80, 2))
    few = {r.a for r in substring_dedup._links(spark.createDataFrame([(1, i) for i in range(len(texts))], "key long, id long"), _sets_of(spark, texts)).collect()}
    assert few == set(range(0, 80, 2))


def _sets_of(spark, texts):
    import numpy as np

    rows = []
    for i, t in enumerate(texts):
        w = t.split()
        x = np.unique(np.array([hash(tuple(w[k : k + 5])) & (1 << 62) - 1 for k in range(len(w) - 4)], np.uint64))
        rows.append((i, bytearray(x.tobytes()), len(x), *substring_dedup._parity(x)))
    return spark.createDataFrame(rows, "hash long, members binary, n long, parity0 long, parity1 long")


def test_paragraph_cuts_do_not_depend_on_the_surroundings():
    import numpy as np

    rng = np.random.default_rng(0)
    inner = rng.integers(0, 2**63, 80, dtype=np.uint64)
    cuts = []
    for n in (30, 57):
        h = np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), inner, rng.integers(0, 2**63, 20, dtype=np.uint64)])
        found = substring_dedup.paragraph_starts(h, np.array([0, len(h)]))
        cuts.append({int(c) - n for c in found if n + 8 <= c < n + 70})
    assert cuts[0] == cuts[1] and len(cuts[0]) >= 2


def test_paragraph_cuts_and_sets_by_brute_force():
    import numpy as np

    from casetide.llm.common import mix64, seeds

    rng = np.random.default_rng(1)
    for rows in ([0], [0, 0], [0, 5, 5, 300, 349], [0, 49, 99, 150, 150]):
        h = rng.integers(0, 40, rows[-1], dtype=np.uint64)  # few values, so that there are ties
        rank = mix64(h * seeds(1, 31)[0] + np.append(h[1:], np.uint64(0))[: len(h)] * seeds(1, 37)[0])
        for reach in (6, 24):
            naive = set()
            for a, b in itertools.pairwise(rows):
                naive |= {a} if b > a else set()
                naive |= {i for i in range(a + reach + 1, b - reach - 1) if rank[i] < min(rank[i - reach : i]) and rank[i] <= min(rank[i + 1 : i + reach + 1])}
            assert substring_dedup.paragraph_starts(h, np.array(rows), reach).tolist() == sorted(naive)
    values, rows = rng.integers(0, 9, 60, dtype=np.uint64), np.array([0, 1, 7, 40, 60])
    sets, at = substring_dedup._distinct(values.copy(), rows)
    assert [sets[a:b].tolist() for a, b in itertools.pairwise(at)] == [sorted(set(values[a:b].tolist())) for a, b in itertools.pairwise(rows)]
    assert substring_dedup._parities(sets, at).T.tolist() == [substring_dedup._parity(sets[a:b]) for a, b in itertools.pairwise(at)]


def test_lcs():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.lcs_length(a, b) == table[-1][-1]


def test_leaks(spark):
    rng = random.Random(7)
    items = [" ".join(words(rng, n, 4000)) + "." for n in (30, 14, 45, 7, 3)]
    items[2] = items[2].replace(" w", ". w", 1)
    filler = lambda n: " ".join(words(rng, n, 4000))
    changed = items[0].split()
    for i in range(0, len(changed) - 1, 4):
        changed[i] = f"other{i}"
    texts = [f"{filler(50)} {items[0].upper()} {filler(30)}", items[1], f"{filler(80)} {items[2]}\n{filler(10)}", filler(300), f"{filler(20)}, {items[3]} {filler(20)}", None, "", f"{filler(40)} {' '.join(changed)} {filler(40)}", items[4]]
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verdict for r in decontam.find_leaks(frame(spark, texts), benchmark).collect()}
    assert got.pop((7, 0)) == "paraphrase"
    assert got == {(0, 0): "copy", (1, 1): "copy", (2, 2): "copy", (4, 3): "copy"}
    assert decontam.find_leaks(frame(spark, []), benchmark).count() == 0
    assert decontam.find_leaks(frame(spark, texts), benchmark.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontam.drop_leaks(frame(spark, texts[:4]), benchmark).collect()) == [3]


def test_every_paraphrase_is_found(spark):
    rng = random.Random(19)
    items = [" ".join(words(rng, 18 + i, 4000)) + ". " + " ".join(words(rng, 5, 4000)) + "." for i in range(8)]
    items += [" ".join(words(rng, 20 + i, 4000)) + "." for i in range(8)]  # no answer apart
    texts, want = [], set()
    for share in (0.6, 0.7, 0.75):
        for i, item in enumerate(items):
            w = item.split()
            free = len(w) - 5 if i < 8 else len(w)
            gone = len(w) - -int(-share * len(w) // 1)
            for k in range(gone):
                w[int(k * free / gone)] = f"other{k}"
            want.add((len(texts), i))
            texts.append(" ".join(f"z{rng.randrange(10**6)}" for _ in range(50)) + " " + " ".join(w))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verdict for r in decontam.find_leaks(frame(spark, texts), benchmark).collect()}
    assert got == dict.fromkeys(want, "paraphrase")


def test_copies_of_short_items(spark):
    rng = random.Random(23)
    items, texts = [], []
    for n, places in ((7, [3]), (5, [2]), (10, [3, 7])):
        w = words(rng, n, 4000)
        items.append(" ".join(w))
        for k in places:
            w[k] = f"other{k}"
        texts.append(" ".join([f"z{rng.randrange(10**6)}" for _ in range(30)] + w + [f"z{rng.randrange(10**6)}" for _ in range(30)]))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.verdict for r in decontam.find_leaks(frame(spark, texts), benchmark).collect()}
    assert got == {(i, i): "copy" for i in range(3)}


def test_an_id_of_two_texts_loses_only_a_copy(spark):
    texts, ids = ["a b", "a  b", "c d", "c d", "c d", None, "x"], [1, 2, 2, 3, 3, None, None]
    kept = exact_dedup.drop_exact_copies(frame(spark, texts, ids))
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (-1, "x"), (1, "a b"), (2, "c d")]
    twice = exact_dedup.drop_exact_copies(frame(spark, ["q", "q", "r"], [5, 5, 5]))
    assert sorted((r.doc_id, r.text) for r in twice.collect()) == [(5, "q"), (5, "r")]
    near = minhash.drop_near_copies(frame(spark, ["a b c d e", "a b c d e", "other words here"], [0, 1, 1]))
    assert near.count() == 3


def test_rivals_lose_no_link(spark):
    rng = random.Random(29)
    base, sets = list(range(100)), []
    for k in range(160):
        members = set(rng.sample(base, 100 - rng.randrange(0, 24))) | {1000 + rng.randrange(60) for _ in range(rng.randrange(0, 14))}
        sets.append(sorted(members))
    import numpy as np

    members = spark.createDataFrame([(i, bytearray(np.array(x, np.uint64).tobytes())) for i, x in enumerate(sets)], "id long, members binary")
    placed = spark.createDataFrame([(1, i, i) for i in range(len(sets))], "key long, id long, root long")
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))]
    got = [(r.a, r.b) for r in minhash.rivals(placed, lambda ids: members, 80).collect()]
    assert set(got) <= set(links) and reach(range(len(sets)), got) == reach(range(len(sets)), links)
    assert len(set(reach(range(len(sets)), links).values())) > 20
