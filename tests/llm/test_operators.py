"""Operators for training data against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from landgrid.llm import bin_completion, bpe_words, chat_events, cross_parsing, digest_index, golay_simhash, lattice_neardup, lattice_sampling, queries, resync_tokens, toxicity_gbt, warc_store
from landgrid.llm._util import scratch
from landgrid.llm.components import components
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, fp string, digest string"
TEXTS = [None, "", "  \t\n", "a", "A b", "a b c d e", "a b c d  e", "the cat sat on the mat and then it slept all day long", "the cat sat on the mat and then it slept all day long", "The Cat sat on the mat and then it slept all day longer", "日本語 テキスト <|endoftext|> é", "x" * 5000, "İstanbul ς ǅ ﬁ 1½ don't we'LL", "\U0001f600 ok"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0, "x", "y", "z", "w") for i, t in enumerate(TEXTS)] + [(7, TEXTS[7], "en", "s", 0, "x", "y", "z", "w")]
    return spark.createDataFrame(rows, DOCS)


def roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert compare(spark, SF, queries.queries()[name], queries.oracle_sql()[name])[1] == ""


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(200, pairs)
    assert got == {x: want[x] for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# embeddings


def test_e8_decoding_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    got = lattice_neardup.decode_e8(x) / 2
    near = got[:, None] + np.concatenate([np.zeros((1, 8)), lattice_neardup.minimal_vectors() / 2])
    d = ((near - x[:, None]) ** 2).sum(2)
    assert (d.argmin(1) == 0).all() and (((got * 2) % 2 == (got[:, :1] * 2) % 2).all(1) & (got.sum(1) % 2 == 0)).all()


def test_lattice_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * g / np.linalg.norm(g, axis=1)[:, None]
    e8 = lattice_neardup.Lattice(64)
    (a, b), (c, d) = e8.cells(x), e8.cells(y)
    met = (a == c).any(1) | (b == c[:, :, None]).any((1, 2)) | (d == a[:, :, None]).any((1, 2))
    apart = np.array([(int(p) ^ int(q)).bit_count() for p, q in zip(e8.sketches(x).view(np.uint64).ravel(), e8.sketches(y).view(np.uint64).ravel())]).reshape(-1, 2).sum(1)
    assert (met & (apart <= lattice_neardup.SKETCH_BITS)).mean() > 0.95


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([base, base[:10] + rng.normal(size=(10, 64)) * 0.1, base[:5] + rng.normal(size=(5, 64)) * 0.12, base[:3], base[:2]]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] + [1.0] * 63, 1), (903, [1.0] * 63 + [None], 1), (904, [float("inf")] * 64, 1), (905, [], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, id int")
    got = {r.vec_id: r for r in lattice_neardup.near_duplicates(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    want = roots(len(x), list(zip(*np.nonzero(g))))
    assert all(got[i].n_links == g[i].sum() and got[i].component_id == want[i] and got[i].kept == (want[i] == i) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i, *_ in bad) and len(got) == len(rows) + len(bad)
    assert lattice_neardup.near_duplicates(df.limit(0)).count() == 0


# fingerprints


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_every_golay_pair_within_four_bits_shares_a_key():
    rng = random.Random(3)
    a = np.random.default_rng(0).integers(-(2**63), 2**63, 3000)
    b = a.view(np.uint64).copy()
    for i in range(len(b)):
        for k in rng.sample(range(64), rng.randint(0, 4)):
            b[i] ^= np.uint64(1 << k)
    keys = lambda x: set(zip(*(v.tolist() for v in golay_simhash.pair_keys(x))))
    assert {r for r, _ in keys(a) & keys(b.view(np.int64))} == set(range(len(a)))


def test_golay_keys_are_one_or_six():
    v = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    assert set(np.bincount(golay_simhash.golay_keys(v)[0]).tolist()) == {1, 6}


def test_fingerprints(docs):
    got = golay_simhash.fingerprints(docs).collect()
    assert len(got) == len(TEXTS) + 1 and all(r.fp % 2**64 == brute_fingerprint(TEXTS[r.doc_id]) for r in got)


def test_fingerprint_components_against_brute_force(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:25]:  # chains and stars of near fingerprints
        for _ in range(6):
            for k in rng.sample(range(64), rng.randint(1, 3)):
                f ^= 1 << k
            fps.add(f)
    signed = [f - 2**64 if f >> 63 else f for f in sorted(fps)]
    got = {r.fp: r.root for r in golay_simhash.fingerprint_components(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    pairs = [(i, j) for i in range(len(signed)) for j in range(i) if ((signed[i] ^ signed[j]) % 2**64).bit_count() <= 4]
    want = roots(len(signed), pairs)
    mine = [got.get(f, f) for f in signed]
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def five_word_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_texts_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \t", "Ab", "ab", "a b c", "A  b\nc", "x " * 50_000]
    for n in (40, 200, 900):
        for _ in range(25):
            base = [rng.choice(vocabulary) for _ in range(n)]
            texts.append(" ".join(base))
            for rate in (0.003, 0.02, 0.05):
                texts.append(" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base))
    got = golay_simhash.near_texts(spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, digest long")).collect()
    assert len(got) == len(texts)
    mine = {r.doc_id: r.component for r in got}
    sets = [five_word_shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8]
    want = roots(len(texts), pairs)
    assert all(len({want[i] for i in mine if mine[i] == c}) == 1 for c in set(mine.values()))  # nothing is linked that should not be
    assert sum(mine[a] == mine[b] for a, b in pairs) >= 0.97 * len(pairs)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {min(i for i in mine if mine[i] == c) for c in set(mine.values())}


def test_near_texts_just_below_the_similarity_give_few_pairs(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for i in range(150):
        edits = set(range(i % 40, 300, 40))  # 7 or 8 words of 300: 35 to 40 of some 296 shingles, under 0.8 to the base and less to each other
        texts.append(" ".join(f"e{i}x{j}" if j in edits else w for j, w in enumerate(base)))
    sets = [five_word_shingles(t) for t in texts]
    assert not any(similarity(sets[a], sets[b]) >= 0.8 for a in range(len(texts)) for b in range(a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = golay_simhash.sketches(docs)
    met = golay_simhash._met(classes, 0.8)
    ordered = golay_simhash._ordered_sets(met, classes, docs, 5)
    none = spark.createDataFrame([], "id long, root long")
    assert ordered.count() > 100  # they do meet in keys
    assert golay_simhash._rest(met, ordered, none, 0.8).count() <= len(texts)  # of 11,325 pairs
    assert golay_simhash.kept_texts(docs).count() == len(texts)


def test_near_texts_with_shared_ids_and_clashing_names(spark):
    rows = [(None, "one two three", 1), (None, "four", 2), (3, "one two three", 3), (3, "five six", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, d__ int")
    assert sorted(r["d__"] for r in golay_simhash.kept_texts(d).collect()) == [2, 3, 4]
    assert golay_simhash.kept_texts(d).columns == d.columns and golay_simhash.kept_texts(d.limit(0)).count() == 0


def test_sketch_is_the_majority_of_its_shingles(spark):
    text = "The quick brown fox jumps over the lazy dog and runs"
    row = golay_simhash.sketches(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    words = text.lower().split()
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(len(words) - 4)}
    full = 2**64 - 1

    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & full
        z = (z ^ z >> 27) * 0x94D049BB133111EB & full
        return z ^ z >> 31

    assert row.n == len(hashes)
    for k, got in enumerate(row.sketch, 1):
        mixed = [mix(h + k * 0x9E3779B97F4A7C15 & full) for h in hashes]
        assert got % 2**64 == sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed))


def test_near_duplicate_documents(docs):
    got = {r.doc_id: r for r in golay_simhash.near_duplicates(docs).collect()}
    assert got[0].component_id == got[1].component_id == got[2].component_id == 0 and got[0].fingerprint == "0" * 16
    assert got[8].component_id == 7 and golay_simhash.near_duplicates(docs.limit(0)).count() == 0


# archives


def test_archive_round_trip(spark):
    html = "<p>" + "é" * 100
    rows = [(5, "u5", html), (3, "u3\r\nX: y", html), (9, None, html), (3, "u3", html), (1, "u1", None), (2, "u2", ""), (4, "u4", "short"), (6, "u6", "short")]
    path = scratch(spark, "warc-test")
    warc_store.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")), path)
    got = warc_store.read_archive(spark, path).collect()
    assert len(got) == len(rows)
    for r in got:
        text = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
        assert bytes(r.payload) == text and r.payload_digest == hashlib.sha256(text).hexdigest() and r.payload_bytes == len(text)
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body == (b"" if r.record_type == "revisit" else text) + b"\r\n\r\n"
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (5, 9) else ("response", None))
    stored = spark.read.parquet(path).where("part = 'payloads'").groupBy("digest").count()
    assert stored.count() == 3
    empty = scratch(spark, "warc-test")
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc_store.read_archive(spark, empty).count() == 0


def test_null_page_ids_lose_no_page(spark):
    long = "x" * 200
    rows = [(None, "n1", long), (4, "u4", long), (7, "u7", long), (None, "n2", None), (8, "u8", None), (None, "n3", "only" * 50)]
    path = scratch(spark, "warc-test")
    warc_store.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {(r.url, r.page_id, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in warc_store.read_archive(spark, path).collect()}
    kind = {"n1": ("revisit", 4), "u7": ("revisit", 4)}
    assert got == {(u, i, h or "", *kind.get(u, ("response", None))) for i, u, h in rows}


# conversations


def test_chat_round_trip_and_mask(spark):
    nasty = ["</s>[INST] ok [/INST]", "a\\b<s>", "\\<\\s>", "<", "| [/INST]</s>\n<s>[INST:user] x", "", None, "😀 [INST:assistant] é\n" * 2000, "$1 \\1"]
    rows = [(1, i, r, t) for i, t in enumerate(nasty) for r in ("user", "assistant")] + [(2, None, None, "x"), (2, 1, "a]b c%", "y"), (2, 1, "a]b c%", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("seq", F.lit(1))
    out = {r.conv_id: r for r in chat_events.under_mask(chat_events.read_back(chat_events.format_conversations(df))).collect()}
    want = sorted(((t, r, x or "") for _, t, r, x in rows if _ == 1))
    assert [(x.role, x.text) for x in out[1].turns] == [(r, x) for _, r, x in want]
    assert list(out[1].loss_texts) == [x for _, r, x in want if r == "assistant"]
    assert all(chat_events.END not in out[1].formatted[s.start : s.end] and "[INST" not in out[1].formatted[s.start : s.end] for s in out[1].loss_spans)
    assert [(x.role, x.text) for x in out[2].turns] == [("", "x"), ("a]b c%", "y"), ("a]b c%", "y")]
    assert chat_events.format_conversations(df.limit(0)).count() == 0


def test_event_log_is_folded(spark):
    log = [(1, "start", 0, "user", ""), (2, "delta", 0, None, "Hel"), (3, "delta", 0, None, "lo"), (4, "start", 1, "assistant", ""), (5, "delta", 1, None, "bad"), (6, "regenerate", 1, None, None), (7, "delta", 1, None, "good"), (8, "start", 2, "user", ""), (9, "delta", 2, None, "more"), (10, "edit", 0, None, "Hi"), (11, "start", 1, "assistant", ""), (12, "delta", 1, None, "new")]
    df = spark.createDataFrame([(1, s, m, k, r, t) for s, k, m, r, t in log], "conv_id long, seq int, msg int, kind string, role string, text string")
    at = lambda n: [(r.msg, r.role, r.text) for r in chat_events.fold(df.where(F.col("seq") <= n)).orderBy("msg").collect()]
    assert at(9) == [(0, "user", "Hello"), (1, "assistant", "good"), (2, "user", "more")]
    assert at(12) == [(0, "user", "Hi"), (1, "assistant", "new")]


# exact copies


def test_exact_dedup_edges(docs):
    got = digest_index.exact_dedup(docs).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS) + 1 and sum(r.kept for r in got if r.doc_id == 7) == 1
    by = {r.doc_id: r for r in got}
    assert by[0].keep_id == by[2].keep_id == 2 and by[0].group_size == 3 and by[5].keep_id == 6 and by[8].keep_id == 7
    kept = digest_index.kept_documents(docs, digest_index.exact_dedup(docs))
    assert kept.columns == docs.columns and kept.groupBy("doc_id").count().where("count > 1").count() == 0


def test_null_and_repeated_doc_ids_lose_no_text(spark):
    rows = [(None, "a  b"), (3, "a b"), (None, "c"), (5, "c"), (None, "d"), (None, "d"), (9, "one"), (9, "another"), (1, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = digest_index.exact_dedup(df)
    assert got.count() == 9 and got.where("kept").count() == 5 and got.where("kept IS NULL").count() == 0
    kept = {(r.doc_id, r.text) for r in digest_index.kept_documents(df, got).collect()}
    assert kept == {(None, "a  b"), (5, "c"), (None, "d"), (9, "one"), (1, "another")}


def test_index_persists_between_batches(spark, docs):
    index = digest_index.DigestIndex(spark)
    digest_index.exact_dedup(docs.where("doc_id < 6"), index)
    n = index.rows().count()
    got = {r.doc_id: r for r in digest_index.exact_dedup(docs.where("doc_id >= 6"), index).collect()}
    assert not got[6].kept and got[6].keep_id == 5 and got[11].kept and index.rows().count() > n
    assert digest_index.exact_dedup(docs.limit(0)).count() == 0
    spark.sql(f"DROP TABLE {index.name}")


# tokens


def test_fast_paths_equal_the_library():
    from tokenizers import Tokenizer

    b, w = bpe_words.ByteBpe(), bpe_words.WordBpe()
    hb, hw = Tokenizer.from_file(b.file), Tokenizer.from_file(w.file)
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x250)] + [" ", "'s", "\n", "  ", "'LL", "don", "ing", "日", "é"] * 40
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(600)] + [t or "" for t in TEXTS] + ["<|endoftext|> a<|endoftext|>", "<|startoftext|>", "a<|endof|>"]
    for t in texts:
        ids = hb.encode(t, add_special_tokens=False).ids
        assert b.encode(t) == ids and b.count(t) == len(ids)
        assert np.frombuffer(w.encode(t), "<u4").tolist() == hw.encode(t, add_special_tokens=False).ids


def test_splicing_counts_whole_texts():
    b = bpe_words.ByteBpe()
    text = " ".join("".join(random.Random(i).choices("abcé1,.", k=i % 9 + 1)) for i in range(900))
    for t in (text, text + "ab" * 900 + text, "y" * 3000, " " * 500 + "a", text.replace("b", "<|endoftext|>"), text.replace("c", "日")):
        for chunk in (40, 333):
            n, chunks, _ = resync_tokens.spliced_count(b, t, chunk, 8)
            assert n == len(b.encode(t)) and chunks > 1


def test_token_counts(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_words.tokenizer_path("byte_bpe_50k.json"))
    for r in resync_tokens.count_tokens(docs, chunk=100).collect():
        text = TEXTS[r.doc_id] or ""
        assert r.n_tokens == len(t.encode(text, add_special_tokens=False).ids) and r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 1024)


# sampled segmentations


@pytest.fixture(scope="module")
def lattices():
    return lattice_sampling.Lattices()


def all_segmentations(lat, text):
    s, found = lat.normalise(text), {}

    def go(i, ids, lp):
        if i == len(s):
            found[tuple(ids)] = lp
            return
        for j in range(i + 1, len(s) + 1):
            if (x := lat.weight.get(s[i:j])) is not None:
                go(j, [*ids, x[0]], lp + x[1])
        if s[i] not in lat.weight:
            raw = s[i].encode()
            go(i + 1, ids + [lat.bytes[b] for b in raw], lp + lat.lowest * len(raw))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(found.values()))
    return {k: v - z for k, v in found.items()}


def test_samples_are_distinct_and_complete(lattices):
    for text in ("ab", "thé at", "日x\n", "a  b", "▁a"):
        want = all_segmentations(lattices, text)
        got = lattice_sampling.sample(lattices, text, 5, 10_000)
        assert {tuple(s["ids"]) for s in got} == set(want) and len(got) == len(want)
        assert all(abs(want[tuple(s["ids"])] - s["log_prob"]) < 1e-9 for s in got)
        assert [s["value"] for s in got] == sorted((s["value"] for s in got), reverse=True)
        assert all(lattice_sampling.decode(lattices, s["ids"]) == text.replace("▁", " ") for s in got)


def test_samples_follow_their_probabilities(lattices):
    lat = lattice_sampling.Lattices(alpha=0.2)
    p = {k: np.exp(v) for k, v in all_segmentations(lat, "cat").items()}
    n, first, second = 4000, {}, {}
    for key in range(n):
        a, b = (tuple(s["ids"]) for s in lattice_sampling.sample(lat, "cat", key, 2))
        first[a] = first.get(a, 0) + 1
        second[b] = second.get(b, 0) + 1
    assert all(abs(first.get(k, 0) / n - q) < 0.03 for k, q in p.items())
    want2 = {k: sum(p[j] * q / (1 - p[j]) for j in p if j != k) for k, q in p.items()}
    assert all(abs(second.get(k, 0) / n - q) < 0.03 for k, q in want2.items())


def test_segmentations_of_documents(docs):
    rows = lattice_sampling.sampled_segmentations(docs).collect()
    again = {(r.doc_id, r.rank): r.ids_crc32 for r in rows}
    assert all(again[r.doc_id, r.rank] == r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    assert {r.doc_id for r in rows} == set(range(len(TEXTS))) and all(r.log_prob <= 0 and r.log_inclusion <= 0 for r in rows)


def test_segmentation_query_encodes_and_decodes_all(spark, lattices):
    rows = lattice_sampling.op7(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = {r.doc_id: r.ids for r in rows if r.rank == 0}
    assert first == {i: lattice_sampling.encode(lattices, t) for i, t in texts.items()}
    assert all(r.round_trip and lattice_sampling.decode(lattices, r.ids) == texts[r.doc_id].replace("▁", " ") for r in rows)


# language and toxicity


def test_phrases_are_longest_matches():
    text = " abra cadabra alakazam "
    a = cross_parsing.SuffixAutomaton(text)

    def brute(word):
        s, n, i = f" {word} ", 0, 0
        while i < len(s):
            j = i + 1
            while j < len(s) and s[i : j + 1] in text:
                j += 1
            n, i = n + 1, j
        return n

    rng = random.Random(4)
    for w in ["abra", "kadabra", "zzz", "x", "abrak"] + ["".join(rng.choices("abrcdklzmq", k=rng.randint(1, 12))) for _ in range(300)]:
        assert a.phrases(w) == brute(w), w


def test_language_accuracy_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cross_parsing.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and 0 <= r[1] and r[2] <= 1


def test_language_edges(docs):
    got = {r.doc_id: r for r in cross_parsing.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[7].lang_pred == "en"
    assert cross_parsing.tagged(docs, {}).where("__lang_pred = 'und'").count() == docs.count()
    assert cross_parsing.identify(docs.limit(0)).count() == 0


def test_isotonic_is_the_best_monotone_fit():
    k, v = toxicity_gbt.isotonic(np.array([3.0, 1, 2, 4, 4]), np.array([0.0, 0, 1, 1, 0]))
    assert k.tolist() == [1, 1, 2, 4] and v.tolist() == [0, 0, 0.5, 0.5]


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = toxicity_gbt.Boosted(x[:1500], y[:1500])
    assert ((m.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_toxicity_on_held_out_rows(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity_gbt.score(d, lab).where("held_out").join(lab, "doc_id")
    r = got.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert r[0] > 0.6 and r[1] < 0.03


def test_toxicity_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity_gbt.score(docs, none).collect()
    assert len(got) == docs.count() and all(r.score == 0 and r.predicted == 0 for r in got)
    f = toxicity_gbt.Features({"bad": 2.0}, {})
    assert np.isfinite(f.of(None)).all() and f.of("you are b@d, 1d10t!")[15] > 0


# packing


def test_completion_is_optimal_on_small_bins():
    import itertools

    rng = random.Random(7)
    for _ in range(60):
        room = rng.randint(1, 30)
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 8))]
        best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)
        got = bin_completion.complete(np.bincount(items or [0], minlength=31) * (np.arange(31) > 0), room)
        assert sum(got) == best and not [x for x in set(got) if got.count(x) > items.count(x)]


def test_packing_is_gapless_and_tight(spark, docs):
    rng = random.Random(2)
    more = spark.createDataFrame([(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma,", "x1"], k=rng.randint(1, 90))), "en", "s", 0, "x", "y", "z", "w") for i in range(300)], DOCS)
    rows = bin_completion.pack_documents(docs.unionByName(more), capacity=64).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(v[-1]) <= 64
    assert len(bins) <= -(-sum(r.length for r in rows) // 64) + 1
    w = bpe_words.WordBpe()
    ids = {i: w.encode(t or "") + b"\0\0\0\0" for i, t in enumerate(TEXTS)}
    for r in rows:
        if r.doc_id in ids:
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.start == 64 * r.piece
    assert bin_completion.pack_documents(docs.limit(0)).count() == 0


def test_thousands_of_empty_and_one_token_texts(spark):
    count = np.zeros(2049, np.int64)
    count[[1, 500]] = 3000, 20
    assert sum(t for _, t in bin_completion.plan(count)) == -(-13000 // 2048)
    df = spark.range(7000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN '' WHEN id < 6900 THEN 'a' ELSE repeat('a b ', 250) END AS text")
    rows = bin_completion.pack_documents(df).collect()
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in bins.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(v[-1]) <= 2048
    assert len({r.doc_id for r in rows}) == 7000 and len(bins) == -(-sum(r.length for r in rows) // 2048)


def test_plan_is_least_and_never_above_best_fit():
    def used(steps, n):
        assert all(sum(f) < n for f, _ in steps)
        return sum(np.bincount(f, minlength=n) * t for f, t in steps)

    def least(items, capacity):
        best = len(items)

        def go(rest, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if not rest:
                best = len(bins)
                return
            for i in {r: i for i, r in enumerate(bins)}.values():
                if bins[i] >= rest[0]:
                    go(rest[1:], [*bins[:i], bins[i] - rest[0], *bins[i + 1 :]])
            go(rest[1:], [*bins, capacity - rest[0]])

        go(sorted(items, reverse=True), [])
        return best

    hard = np.bincount([994, 973, 845, 821, 775, 534, 353, 343, 307], minlength=2049)
    for times in (1, 1000):
        steps = bin_completion.plan(hard * times)
        assert sum(t for _, t in steps) == 3 * times and (used(steps, 2049) == hard * times).all()
    rng, better = random.Random(11), 0
    for _ in range(150):
        capacity = rng.choice([20, 30, 50])
        items = [rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randint(1, 11))]
        count = np.bincount(items, minlength=capacity + 1)
        steps, fit = bin_completion.plan(count, capacity), bin_completion.best_fit(count, capacity)
        n, m = (sum(t for _, t in x) for x in (steps, fit))
        assert (used(steps, capacity + 1) == count).all() and (used(fit, capacity + 1) == count).all()
        assert bin_completion.lower_bound(count, capacity) <= n == least(items, capacity) <= m
        better += n < m
    assert better


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["language_id", "toxicity", "exact_dedup", "simhash_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for _, f in c.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        path = scratch(spark, "stage-test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > seen[0] // 2
    near = golay_simhash.near_duplicates(docs)
    assert near.where("doc_id <> component_id").count() == 0
    assert c.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == seen[-1]


# rows and edges of the second round


def test_vectors_that_share_an_id_keep_a_row_each(spark):
    rng = np.random.default_rng(3)
    a, c = rng.standard_normal(64), rng.standard_normal(64)
    b = a + 0.05 * rng.standard_normal(64)  # linked to a
    rows = [(5, a.tolist()), (5, b.tolist()), (6, c.tolist()), (7, a.tolist()), (8, None), (5, None), (9, [0.0] * 64), (None, c.tolist())]
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in lattice_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(-1, 1, 6, False), (5, 0, 5, True), (5, 2, 5, True), (5, 2, 5, True), (6, 1, 6, True), (7, 2, 5, False), (8, 0, 8, True), (9, 0, 9, True)]


def test_planted_links_around_the_threshold(spark):
    rng, rows = np.random.default_rng(11), []
    for k in range(400):
        x = rng.standard_normal(64)
        x /= np.linalg.norm(x)
        y = rng.standard_normal(64)
        y -= y @ x * x
        cos = 0.93 + 0.04 * k / 400
        rows += [(2 * k, x.tolist()), (2 * k + 1, (cos * x + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y)).tolist())]
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(m @ m.T >= 0.95)) if i < j}
    got = {r.vec_id for r in lattice_neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links > 0").collect()}
    ends = {i for pair in want for i in pair}
    assert got <= ends and len(got) >= 0.98 * len(ends)


def test_tables_are_segmented_as_single_texts(spark, lattices):
    texts = [None, "", " ", "a  b <s> é😀\n x", "▁▁ x ▁y", "hello wonderful world", "日本語", "x" * 300, "tokenisation of sentences, in pieces.\n" * 4]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "hello"), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("rank", F.lit(1))
    got = lattice_sampling.sampled_segmentations(docs, 3, with_encoding=True).collect()
    for doc_id, text in rows:
        want = lattice_sampling.sample(lattices, text or "", doc_id or 0, 3)
        mine = [r for r in got if r.doc_id == doc_id]
        assert all(r.round_trip for r in mine)
        for r in mine:
            if r["rank"]:
                w = want[r["rank"] - 1]
                assert r.ids == w["ids"] and abs(r.log_prob - w["log_prob"]) < 1e-6 and abs(r.log_inclusion - w["log_inclusion"]) < 1e-6
            else:
                assert r.ids == lattices.sp.encode(text or "")
    assert lattice_sampling.sampled_segmentations(docs.limit(0)).count() == 0


def test_tables_are_encoded_and_decoded_as_the_library_does(spark, lattices):
    texts = [None, "", "a  b <s> é😀\n x", "    lots    of     spaces      ", "x" * 70_000, "日本語 テキスト <|endoftext|> é", "\x00\x7f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in lattice_sampling.decoded(lattice_sampling.encoded(docs), to="back").collect():
        assert (r.ids, r.back) == ((None, None) if r.text is None else (lattices.sp.encode(r.text), lattices.sp.decode(lattices.sp.encode(r.text))))


def test_languages_of_a_whole_table_by_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, "½ ²", None), (9002, "Ⅷ", None), (9003, None, "en"), (9004, "İstanbul ñandú", None), (9005, "नमस्ते दुनिया", None), (9006, "w" * 50_000, None), (9007, "a", None), (9007, "a", None)]
    d = d.unionByName(spark.createDataFrame(odd, d.schema))
    texts = {k: v[:5000] for k, v in cross_parsing.fit(d, 20, 40_000).items()}

    def brute(text):
        """Longest matches by looking each one up in the labelled text."""
        words = cross_parsing.normal((text or "").replace("\0", " "))
        cost = []
        for lang, labelled in sorted(texts.items()):
            t, i, bits = cross_parsing.normal(labelled), 0, 0.0
            while i < len(words):
                j = i + 1
                while j < len(words) and words[i : j + 1] in t:
                    j += 1
                places = sum(t.startswith(words[i:j], k) for k in range(len(t))) if words[i:j] in t else 1
                bits += np.log2(len(t)) - np.log2(places)
                i = j
            cost.append((bits, lang))
        cost.sort()
        return ("und", 0.0) if len(words) < 2 or not words.strip() else (cost[0][1], cost[1][0] / (cost[0][0] + cost[1][0]))

    model, got = cross_parsing.Model(texts), cross_parsing.identify(d, texts).collect()
    assert len(got) == d.count()
    by = {}
    for r in d.collect():
        by.setdefault(r.doc_id, r.text)
    for r in got:
        lang, score = model.predict(by[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6
        if len(by[r.doc_id] or "") < 150:
            assert brute(by[r.doc_id])[0] == lang and abs(brute(by[r.doc_id])[1] - score) < 1e-9
    assert {r.lang_pred for r in got if r.doc_id in (9001, 9002, 9003)} == {"und"}
    with pytest.raises(ValueError):
        cross_parsing.tagged(d.withColumn("__lang_pred", F.lit("x")), texts)


def test_index_of_a_call_is_dropped(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    assert digest_index.exact_dedup(docs).count() == docs.count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_pipeline_stages_by_brute_force(spark):
    """Each stage on nulls, empty texts, copies, near copies and extra columns, against plain Python."""
    import corpus_pipeline as P

    words = "the cat sat on the mat and then it slept all day long under a warm sun while birds sang".split()
    base = " ".join(words * 3)
    rows = [(1, base), (2, base.replace(" ", "  ")), (3, base + " x"), (4, None), (5, ""), (6, "½"), (7, "Another short text about rivers and hills."), (7, "Quite a different text of the same id."), (8, "a b"), (9, "A  B"), (None, "no id here"), (10, base)]
    d = spark.createDataFrame([(i, t, "en", "s", 0, "e") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __extra string")
    plain = lambda df: sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())
    kept = P.language_id(spark, d, SF)
    assert kept.columns == d.columns and plain(kept) == sorted((i if i is not None else -1, t) for i, t in rows if t and any(c.isalpha() for c in t))

    best = {}
    for i, t in rows:
        key = "".join(c for c in t or "" if c not in " \t\n\x0b\f\r")
        rank = (-len(t or ""), i is None, i or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, (i if i is not None else -1, t or ""))
    deduped = P.exact_dedup(spark, d, SF)
    assert deduped.columns == d.columns and plain(deduped) == sorted(v for _, v in best.values())

    some = d.where("doc_id IS NOT NULL")
    ids = [(i, t) for i, t in rows if i is not None]
    sets = [five_word_shingles(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8])
    first = {}
    for (i, t), r in zip(rows, root):
        rank = (i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest())
        first[r] = min(rank, first.get(r, rank))
    near = P.simhash_dedup(spark, d, SF)
    assert near.columns == d.columns
    assert {(r.doc_id is None, r.doc_id or 0, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in near.collect()} == set(first.values())

    packed = P.packing(spark, some, SF).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe_words.tokenizer_path("word_bpe_49k.json"))
    lengths = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ids)
    assert sorted(r.length for r in packed) == lengths and len({r.sequence_id for r in packed}) == 1 == -(-sum(lengths) // 2048)
    for _, stage in P.STAGES:
        assert stage(spark, d.limit(0), SF).count() == 0


def test_toxicity_scores_by_plain_loops(spark):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity_gbt.fit(d, lab)
    got = toxicity_gbt.scored(d, model).select("doc_id", "text", "__toxicity").collect()
    assert len(got) == d.count() and all(0 <= r["__toxicity"] <= 1 for r in got)
    features = toxicity_gbt.Features(model.words, model.starts)

    def plain(text):
        x, f = features.of(text), model.model.base
        for feature, cut, value in model.model.trees:
            node = 1
            for _ in range(model.model.depth):
                j = int(feature[node])
                node = 2 * node + (sum(c < x[j] for c in model.model.cuts[j]) > cut[node])
            f += model.model.rate * value[node - 2**model.model.depth]
        k, v = model.knots.tolist(), model.values.tolist()
        if f <= k[0] or f >= k[-1]:
            return v[0] if f <= k[0] else v[-1]
        i = max(i for i, x in enumerate(k) if x <= f)
        return v[i] if k[i] == f else v[i] + (v[i + 1] - v[i]) * (f - k[i]) / (k[i + 1] - k[i])

    assert all(abs(plain(r.text) - r["__toxicity"]) < 1e-9 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "word " * 200_000, "z"), (None, "you are a word", "w")], "doc_id long, text string, score string")
    for r in toxicity_gbt.scored(odd, model).collect():
        assert abs(plain(r.text) - r["__toxicity"]) < 1e-9
    assert toxicity_gbt.scored(d.limit(0), model).count() == 0
