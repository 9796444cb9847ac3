"""Archives, token files, packing, licences, language models and language ID."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from casetide.llm import langid, licences, lm_score, packing, tokens, warc
from casetide.llm.common import shared_folder
from casetide.llm.tokens import WaveletMatrix

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows, schema="doc_id long, text string, lang string, source string"):
    return spark.createDataFrame([(*r, *("en", "s")[: 4 - len(r)]) if len(r) < 4 else r for r in rows], schema)


def test_archive_round_trip(spark):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b\r\nX: y", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "line\r\n\r\nbreak"), (5, "v", "line\r\n\r\nbreak")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' AS header", "'y' AS sha256")
    folder = shared_folder(spark)
    warc.write_archive(table, folder)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(spark, folder).collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    size = lambda t: len((t or "").encode())
    kind = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    assert got == sorted((i, size(h), digest(h), *kind[i]) for i, _, h in pages)
    payloads = spark.read.parquet(f"{folder}/payloads")
    assert payloads.count() == 3
    records = {r.page_id: bytes(r.record) for r in warc.records(spark, folder).collect()}
    assert records[5].endswith(b"line\r\n\r\nbreak\r\n\r\n") and b"\r\nX: y" not in records[2]
    assert f"Content-Length: {size('<p>é</p>')}\r\n\r\n<p>é</p>".encode() in records[2]
    back = {r.page_id: r.html for r in warc.pages_back(spark, folder).collect()}
    assert back[1] == "<p>é</p>" and back[3] == ""
    target = shared_folder(spark)
    warc.export_warc(spark, folder, target)
    whole = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(target).collect())
    assert sorted(whole.split(b"WARC/1.1\r\n")[1:]) == sorted(r.split(b"WARC/1.1\r\n")[1] for r in (bytes(x.record) for x in warc.records(spark, folder).collect()))


def test_damaged_archive_fails(spark):
    folder = shared_folder(spark)
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), folder)
    spark.createDataFrame([("0" * 64, bytearray(b"y"))], "sha256 string, payload binary").write.mode("append").parquet(f"{folder}/payloads")
    with pytest.raises(Exception, match="match its digest"):
        warc.read_archive(spark, folder)[1].collect()


def test_empty_archive(spark):
    folder = shared_folder(spark)
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.archived_pages(spark, folder).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000) | st.integers(0, 3), max_size=700))
def test_wavelet_matrix(ids):
    a = np.array(ids, np.uint32)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(a).to_bytes())
    assert len(w) == len(a) and (w.decode() == a).all()
    for token in {*ids[:5], 1, 99999}:
        places = np.flatnonzero(a == token)
        assert w.count(token) == len(places)
        assert [w.select(token, k) for k in range(len(places))][:3] == places[:3].tolist()
        assert w.rank(token, len(a) // 2) == (a[: len(a) // 2] == token).sum()
    for i in range(0, len(ids), 37):
        assert w.access(i) == ids[i]
    with pytest.raises(IndexError):
        w.access(len(ids))


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = ["Hello, World's don't", None, "", "a<|endoftext|>b", "x y É́cole №5 'S 's,", "tab\there\x1cnow — “q”,", "I'll WE'RE 12ab34", "word," * 2000, "don''t (a)b.c 'tis", "ÀÉ,é! ñ."]
    for t in texts:  # piece by piece, too
        ids, sizes = tokens.Encoder(PATH)(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    shards = tokens.write_tokens(docs(spark, [(i * 3, t) for i, t in enumerate(texts)]), PATH, shard_tokens=50)
    got = sorted(tuple(r) for r in tokens.read_tokens(shards).collect())
    start, want = 0, []
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i * 3, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert tokens.read_tokens(tokens.write_tokens(docs(spark, []), PATH)).count() == 0


def test_tokens_of_other_tokenizers_and_repeated_ids(spark):
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert tokens.encoder(PATH).by_pieces and not tokens.encoder(other).by_pieces
    library = Tokenizer.from_file(other)
    texts = ["Don't  stop", "é <|x", None, "a b", "a b", "zz" * 50]
    got = sorted((r.doc_id or -1, r.n_tokens) for r in tokens.read_tokens(tokens.write_tokens(docs(spark, list(zip([3, 1, None, 3, 3, None], texts, strict=True))), other)).collect())
    assert got == sorted((i, 1 + len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip([3, 1, -1, 3, 3, -1], texts, strict=True))


def test_encoder_that_forgets_and_words_that_folding_splits(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    library, encode, rng = Tokenizer.from_file(PATH), tokens.Encoder(PATH), random.Random(4)
    for _ in range(30):
        text = " ".join("".join(rng.choice("aàb1'İ-") for _ in range(rng.randrange(1, 9))) for _ in range(12))
        data = text.encode()
        assert encode(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids, text


def naive_best_fit(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= length and cluster not in b[2] and (source is None or source not in b[1])]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([capacity, set(), set()])
        out.append((k, capacity - bins[k][0]))
        bins[k][0] -= length
        bins[k][1].add(source)
        bins[k][2].add(cluster)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(0)
    for _ in range(30):
        pieces = [(rng.randrange(1, 60), rng.choice([None, 0, 1, 2, 3]), rng.randrange(20)) for _ in range(80)]
        assert packing.best_fit(pieces, 64) == naive_best_fit(pieces, 64)


def test_packing_keeps_everything(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 300))) or None, "en", rng.choice(["a", "b", None])) for i in range(200)] + [(None, "x y", "en", "a"), (7, "x y", "en", "b")]
    out = packing.pack(docs(spark, rows), capacity=100, shard=64).collect()
    lengths = {}
    for r in out:
        lengths.setdefault(r.doc_id, 0)
        lengths[r.doc_id] += r.length
    for i, t, *_ in rows[:200]:
        extra = 3 if i == 7 else 0
        assert lengths[i] == len((t or "").split()) + 1 + extra
    bins = {}
    for r in sorted(out, key=lambda r: (r.bin_id, r.at)):
        assert r.at == bins.get(r.bin_id, 0)
        bins[r.bin_id] = r.at + r.length
    assert max(bins.values()) <= 100
    assert packing.pack(docs(spark, [])).count() == 0


def test_licences(spark):
    cc = "Some text\nThis work is licensed under a Creative Commons Attribution 4.0 International License.\nMore"
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "released UNDER the mit license"), (3, "Released under the BSD License."), (4, None), (5, ""), (6, "license"), (7, cc), (8, "MIT License\nApache"), (9, "All rights reserved. Licensed under CC BY 4.0.")]
    got = {r.doc_id: (r.licence, r.dice) for r in licences.scan(docs(spark, rows)).collect()}
    assert got[1] == ("MIT", 1.0) and got[2] == ("MIT", 1.0) and got[7] == ("CC-BY-4.0", 1.0)
    assert all(got[i] == (None, None) for i in (3, 4, 5, 6, 8))
    assert licences.scan(docs(spark, [])).count() == 0


def test_anchor_words_prune_nothing_that_matches():
    chosen = set(licences.anchors(licences.TEMPLATES))
    for _, text in licences.TEMPLATES:
        words = licences.template_words(text)
        bigrams = set(zip(words, words[1:], strict=False))
        left = [b for b in bigrams if not chosen & set(b)]
        assert 2 * len(left) / (len(left) + len(bigrams)) < licences.THRESHOLD


def test_scores_equal_brute_force(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("red green blue the of cat dogs".split()) for _ in range(rng.randrange(0, 30)))) for i in range(25)] + [(25, None), (26, "unseen words here")]
    labels = [(i, int(i % 3 == 0), 0) for i in range(0, 20)] + [(None, 1, 0), (3, 0, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.score(docs(spark, rows), table, PATH).collect()}
    v, mass = lm_score.VOCABULARY, lm_score.MASS
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    losses = {}
    for name, chosen in (("background", set(ids)), ("target", good)):
        uni, bi, ctx = {}, {}, {}
        for i in chosen:
            for a, b in zip([lm_score.MARK, *ids[i]], ids[i], strict=False):
                uni[b] = uni.get(b, 0) + 1
                bi[a, b] = bi.get((a, b), 0) + 1
                ctx[a] = ctx.get(a, 0) + 1
        n = sum(uni.values())
        p = lambda a, b: (bi.get((a, b), 0) + mass * (uni.get(b, 0) + 1) / (n + v)) / (ctx.get(a, 0) + mass)  # noqa: B023, E731
        losses[name] = {i: -sum(np.log2(p(a, b)) for a, b in zip([lm_score.MARK, *t], t, strict=False)) / len(t) for i, t in ids.items() if t}
    for i in ids:
        assert got[i].n_tokens == len(ids[i])
        if ids[i]:
            assert got[i].background_loss == pytest.approx(losses["background"][i])
            assert got[i].score == pytest.approx(losses["target"][i] - losses["background"][i])
        else:
            assert got[i].score is None


def test_language_id(spark):
    rng = random.Random(6)
    syllables = {"aa": "ka lo mi tu".split(), "bb": "schen ung ver zeit".split(), "cc": "été que œil ça".split()}
    rows = []
    for i in range(600):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randrange(3, 60))), lang if i % 7 else None, "s"))
    rows += [(1000, None, "aa", "s"), (1001, "123 !!", "bb", "s"), (None, "kalomi tuka", "aa", "s"), (1003, "", None, "s")]
    table = docs(spark, rows)
    got = langid.identify(table).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [(lang, by_id[i].lang_pred) for i, _, lang, _ in rows[:600] if by_id[i].held_out and lang]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert {by_id[i].lang_pred for i in (1000, 1001, 1003)} == {"und"}
    kept = langid.keep_identified(table)
    assert kept.columns == table.columns and kept.count() == 601
    assert langid.identify(docs(spark, [])).count() == 0
    unlabelled = docs(spark, [(1, "abc", None, "s")])
    assert langid.identify(unlabelled).first().lang_pred == "und"
