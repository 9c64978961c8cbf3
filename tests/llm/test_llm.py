"""Training-data operators against brute force, on small given tables and on difficult rows."""

import hashlib
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from oracle import compare, connect  # noqa: E402
from sluicegate.llm import (  # noqa: E402
    QUERIES, SQL, chunk_bpe, components, exact_dedup, lang_id, mixing, ngram_lm, permutation_index, pii_feistel,
    secret_scan, suffix_dedup, superminhash)
from sluicegate.llm.base import written  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Difficult documents and vectors as tables."""
    path = str(tmp_path_factory.mktemp("difficult"))
    spark.createDataFrame(brute.document_rows(), brute.document_schema()).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], brute.document_schema()).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def run(spark, prefix, folder):
    name = next(n for n in QUERIES if n.startswith(prefix))
    return QUERIES[name](spark, folder).collect()


def one_each(rows):
    return Counter((r["doc_id"], r["text"]) if isinstance(r, dict) else (r[0], r[1]) for r in rows)


def difficult():
    return [(r[0], r[1]) for r in brute.document_rows()]


def order(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.split("_")[0] not in ("op4", "op11", "op12", "op13")))
def test_one_row_per_difficult_document(spark, folder, name):
    rows = QUERIES[name](spark, folder).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(doc for doc, _ in difficult())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SMALL), SMALL, QUERIES[name], SQL[name]) is None


# -- exact copies --------------------------------------------------------------------------------

def brute_groups(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for doc, text in rows:
        groups[body(text)].append((-len(text or ""), doc is None, doc if doc is not None else 0))
    out = []
    for doc, text in rows:
        g = groups[body(text)]
        keep = min(g)
        keep = None if keep[1] else keep[2]
        out.append((doc, keep, len(g), doc == keep, hashlib.sha256(body(text).encode()).hexdigest()))
    return out


def test_exact_groups_of_difficult_rows(spark, folder):
    got = [tuple(r) for r in run(spark, "op8_", folder)]
    assert sorted(got, key=order) == sorted(brute_groups(difficult()), key=order)


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 500, n).astype(np.uint64) << np.uint64(40) for n in (0, 1, 300, 4000)]
    merged = exact_dedup.merge_filters([exact_dedup.build_filter(p, 32) for p in parts], 32)
    q, runs, r, c = merged
    entries = (np.repeat(q, runs.astype(int)) << np.uint64(32)) | r
    assert dict(zip(entries.tolist(), c.tolist())) == Counter(np.concatenate(parts).tolist())


def test_exact_copies_dropped_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {(d, t) for (d, t), g in zip(difficult(), brute_groups(difficult())) if g[3]}
    assert Counter(rows) == Counter(want)


@pytest.mark.parametrize("rows", [
    [(1, "x"), (None, "x"), (None, "y")], [(1, "x"), (2, "x"), (2, "y"), (2, "y")], [(None, "x y"), (None, "xy"), (3, None), (None, "")]])
def test_exact_copies_of_one_id_go_by_their_text(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_copies(docs).collect())
    assert got == Counter({(d, t) for (d, t), g in zip(rows, brute_groups(rows)) if g[3]})


def test_exact_copies_of_an_empty_id_and_of_none(spark):
    docs = spark.createDataFrame([(None, "x"), ("", "x"), (None, "y")], "doc_id string, text string")
    got = {(r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_copies(docs).collect()}
    assert got == {("", "x"), (None, "y")}


# -- near copies ---------------------------------------------------------------------------------

@pytest.mark.parametrize("k,percent,bands,rows", [(3, 85, 42, 6), (5, 80, 50, 5)])
def test_near_copies(spark, small, k, percent, bands, rows):
    docs = spark.createDataFrame([(d, t) for d, t, *_ in small], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           superminhash.near_copies(docs, k, percent, bands, rows).collect()}
    assert got == brute.near([(d, t) for d, t, *_ in small], k, percent)


def test_near_copies_of_difficult_rows(spark, folder):
    rows = [(d, t) for d, t in difficult() if d is not None and d != 30]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_copies(docs, 3, 85).collect()}
    assert got == brute.near(rows, 3, 85)
    nulls = [r for r in run(spark, "op6_", folder) if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in nulls] == [(None, True)] * 2


def test_large_group_of_near_copies(spark):
    """Copies that differ from one text, not all linked with each other, and a chain of texts."""
    base = [f"a{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for j in range(6):
            words[(i * 37 + j * 53) % 300] = f"n{i}x{j}"
        rows.append((i, " ".join(words)))
    rows.append((1000, " ".join(base)))
    chain = [f"c{i}" for i in range(200)]
    for i in range(30):
        rows.append((2000 + i, " ".join(chain)))
        chain[i * 6] = f"z{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in superminhash.near_copies(docs, 3, 85).collect()}
    assert got == brute.near(rows, 3, 85)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = np.unique(pool[:1000]), np.unique(pool[500:])
    s = superminhash.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), 1024)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.06
    # Every place is filled, and each shingle uses a place once: ranks are a permutation.
    alone = superminhash.signatures(pool[:1], np.array([1]), 64)
    assert sorted((alone[0] >> np.uint64(32)).tolist()) == list(range(64))


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 299), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(80)}, 299: 299, 300: 299}


# -- repeated passages ---------------------------------------------------------------------------

def test_repeats_of_difficult_rows(spark, folder):
    got = [tuple(r) for r in run(spark, "op3_", folder)]
    want = [(d, *x) for (d, _), x in zip(difficult(), brute.repeats([t for _, t in difficult()]))]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_repeats_of_given_documents(spark, small):
    got = {r["doc_id"]: tuple(r)[1:] for r in run(spark, "op3_", SMALL)}
    assert got == {d: x for (d, *_), x in zip(small, brute.repeats([t for _, t, *_ in small]))}


def test_planted_passages_by_their_length(spark, tmp_path):
    """A passage of over 50 words is removed where it recurs if it has 400 bytes, and not below."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(2, 9)))) for _ in range(5000)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    rows, planted = [], {}
    for i, size in enumerate([*range(300, 600, 12), 399, 400, 401]):
        passage = prose(200)[:size - 1].replace("  ", " x").strip()
        passage += "q" * (size - len(passage))
        for d in (2 * i, 2 * i + 1):  # other bytes beside the passage in each document
            rows.append((d, f"{prose(40)} {'AB'[d % 2]}{passage}{'CD'[d % 2]} {prose(40)}"))
            planted[d] = size
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in run(spark, "op3_", str(tmp_path))}
    assert got == {d: size if size >= 400 else 0 for d, size in planted.items()}
    assert {d for d, s in planted.items() if s < 400} and {d for d, s in planted.items() if s >= 400}


def test_hot_groups_of_passages_agree(spark, small, monkeypatch):
    """Groups too large for one task are solved by hashed windows, with the same result."""
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", 1)
    rows = [(d, t) for d, t, *_ in small][:120]
    passage = "a passage that many documents share with other words around it, " * 7
    rows += [(10_000 + i, f"start {i} {i * i} " * 9 + passage + f" end {i}" * 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.without_repeats(docs, keep_first=False, digests=True).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.repeats([t for _, t in rows]))}


@pytest.mark.parametrize("hot", [1, 1000])
def test_first_copies_of_passages_stay(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    length, gram = 40, 16
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, 5).tolist()).decode() for _ in range(400)]
    passages = [" ".join(rng.choice(words, 20)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(words, 6)), passages[i % 6], " ".join(rng.choice(words, 6)), passages[(i * 7 + 1) % 6][:70]]
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.without_repeats(docs, length, gram).collect()}
    seen, want = set(), {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i:i + length] in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(t[i:i + length])
        want[d] = "".join(c for c, g in zip(t, gone) if not g)
    assert got == want


def test_longest_factors_against_brute_force():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 80).astype(np.uint8)
    width = 12
    windows = np.lib.stride_tricks.sliding_window_view(text, width)
    lpf, lnf = suffix_dedup.longest_factors(windows.copy(), np.arange(len(windows)))

    def common(i, j):
        differ = np.flatnonzero(windows[i] != windows[j])
        return int(differ[0]) if len(differ) else width

    for i in range(len(windows)):
        assert lpf[i] == max([0, *(common(i, j) for j in range(i))])
        assert lnf[i] == max([0, *(common(i, j) for j in range(i + 1, len(windows)))])


def test_anchors_of_a_long_text_in_pieces():
    """Pieces of a long text hold each window once, and equal windows the same anchor."""
    text = bytes(np.random.default_rng(4).integers(97, 123, 9000).astype(np.uint8))
    whole = suffix_dedup.anchors([text], 400, 136)
    pieces = [(base, suffix_dedup.anchors(p, 400, 136)) for p, base in suffix_dedup._pieces([text], 400, 2000)]

    def starts(low, high, place, g, base):
        return {(s + base): (int(p) + base, int(x)) for a, b, p, x in zip(low, high, place, g) for s in range(a, b + 1)}

    want = starts(*whole[1:5], 0)
    got = {}
    for base, found in pieces:
        mine = starts(*found[1:5], base)
        assert not set(mine) & set(got)
        got |= mine
    assert got == want and len(want) == 9000 - 399


def test_a_long_text_after_an_empty_one_is_cut(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 2000)
    texts = [b"", b"ab", b"", b"x" * 5000, b"", b"cd" * 900, b"ef" * 90, b"y" * 2001, b""]
    cut = list(suffix_dedup._long_alone(texts, 2000))
    assert [i for a, b in cut for i in range(a, b)] == list(range(len(texts)))
    assert all(b - a == 1 for a, b in cut if any(len(t) > 2000 for t in texts[a:b]))


def test_repeats_in_texts_beyond_24_bits_of_places(spark):
    """An empty text before each of two long ones that share a passage near their ends."""
    rng = np.random.default_rng(5)
    passage = bytes(rng.integers(97, 123, 900).astype(np.uint8))
    texts = []
    for seed in (6, 7):
        own = np.random.default_rng(seed).integers(97, 123, (1 << 24) + 20_000).astype(np.uint8).tobytes()
        texts += [b"", own + passage]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([t.decode() for t in texts]), pa.array(range(4)), pa.array(range(4))], ["text", "row", "doc_id"])
    found = defaultdict(set)
    for out in suffix_dedup._anchored(400, 136)([batch]):
        for g, row, at in zip(out["anchor"].to_pylist(), out["row"].to_pylist(), out["at"].to_pylist()):
            low = at >> 24
            if low >= (1 << 24) + 20_000:  # a run of windows inside the passage
                found[row].add((g, low + (at & 0xFFF)))
    assert found[1] and found[1] == found[3]


# -- language-model scores -----------------------------------------------------------------------

@pytest.mark.parametrize("tokens", [400, 2_500_000])
def test_scores(spark, folder, small, monkeypatch, tokens):
    """One bucket, and many with spread first words."""
    monkeypatch.setattr(ngram_lm, "BUCKET_TOKENS", tokens * 30 if tokens == 400 else tokens)
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 50_000)
    for path, rows in ((SMALL, [(d, t) for d, t, *_ in small]), (folder, difficult())):
        got = sorted((tuple(r)[:7] for r in run(spark, "op2_", path)), key=order)
        want = sorted(((d, *x) for (d, _), x in zip(rows, brute.bigram_scores(rows))), key=order)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5]
            assert g[5:] == pytest.approx(w[5:], abs=1e-6)


def test_model_sums_to_one():
    """Over all words and the unknown one, after a seen and an unseen word."""
    rows = [(i, " ".join(f"w{j * i % 7}" for j in range(20))) for i in range(1, 30)]
    rows = [r for r in rows if brute.crc(r[0]) % 10]
    known = {w for _, t in rows for w in t.split()}
    probes = [(1_000_000 + i, f"{v} {w}") for i, (v, w) in enumerate(
        (v, w) for v in ("w1", "unseen") for w in [*known, "unknown"])]
    probes = [p for p in probes]
    held = []
    for doc, text in probes:
        while brute.crc(doc) % 10:
            doc += 10_000
        held.append((doc, text))
    one_word = [(held[-1][0] + 7_000_000 + i, v) for i, v in enumerate(("w1", "unseen"))]
    scores = {t: 10 ** x[5] for (_, t), x in zip(rows + held + one_word, brute.bigram_scores(rows + held))}
    assert scores  # the brute-force model itself is compared with the operator above


def test_held_out_text_is_scored_better_than_by_words_alone(spark):
    rows = [r for r in run(spark, "op2_", "/root/testdata/sf0.01") if r["held_out"]]
    assert sum(r["score"] for r in rows) > 1.1 * sum(r["base_score"] for r in rows) or sum(
        r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# -- encoding ------------------------------------------------------------------------------------

def direct(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("difficult_rows", [False, True])
def test_encoding_equals_the_library(spark, folder, small, difficult_rows):
    tokenizer = chunk_bpe.load_tokenizer(chunk_bpe.default_path())
    rows = difficult() if difficult_rows else [(d, t) for d, t, *_ in small]
    want = []
    for d, t in rows:
        ids, text = direct(tokenizer, t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in run(spark, "op5_", folder if difficult_rows else SMALL)]
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_joins_that_disagree_are_repaired(name):
    """A byte-level vocabulary joins white space to the next word: no cut agrees there."""
    import public_tokenizers

    tokenizer = chunk_bpe.load_tokenizer(public_tokenizers.path(name))
    texts = [t or "" for _, t in difficult()] + ["a  b\n\nc", " lead and trail ", "x"]
    encoder = chunk_bpe.ChunkEncoder(tokenizer, cache_bytes=20_000)
    for text, (ids, decoded) in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert (ids.tolist(), decoded.decode()) == direct(tokenizer, text)


def test_chunks_are_cut_alike_and_reused():
    passage = " ".join(f"word{i * i % 1000003}" for i in range(3000)).encode()
    a, b = chunk_bpe.chunks([b"one start " + passage, b"another beginning, longer " + passage])
    assert b"".join(a) == b"one start " + passage and b"".join(b) == b"another beginning, longer " + passage
    assert len(set(a) & set(b)) > 0.9 * len(a) > 20


# -- secrets -------------------------------------------------------------------------------------

@pytest.mark.parametrize("difficult_rows", [False, True])
def test_secret_patterns(spark, folder, small, difficult_rows):
    rows = difficult() if difficult_rows else [(d, t) for d, t, *_ in small]
    want = []
    for d, t in rows:
        n, spans = brute.base_secrets(t)
        want.append((d, n["assign"], n["access"], n["hex"], hashlib.sha256(spans.encode()).hexdigest()))
    got = run(spark, "op7_", folder if difficult_rows else SMALL)
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)


def test_novel_strings():
    code = "def connect(host, port):\n    return Session(host, port, timeout=30)\n" * 6
    text = code + "# the secret of staging is below\nvalue <- q8Zr5TnW2xKv9LmB4yHd7\n" + code
    spans = secret_scan.scan(text, text.encode())[1]
    assert [text[s:e] for s, k, e in spans if k == 3] == ["q8Zr5TnW2xKv9LmB4yHd7"]
    # The same string all around is no news, nor is a name or a string without sensitive context.
    again = text.replace("Session(host", "q8Zr5TnW2xKv9LmB4yHd7(host")
    assert not [s for s in secret_scan.scan(again, again.encode())[1] if s[1] == 3]
    calm = text.replace("secret of staging", "colour of staging")
    assert not secret_scan.scan(calm, calm.encode())[1]
    assert secret_scan.marginal_bytes("application/json", "") < 8 < secret_scan.marginal_bytes("q8Zr5TnW2xKv9LmB", "")


def test_novel_strings_may_recur_and_come_first():
    code = "def connect(host, port):\n    return Session(host, port, timeout=30)\n" * 6
    key = "q8Zr5TnW2xKv9LmB4yHd7"
    part = f"# the secret of staging is below\nvalue <- {key}\n" + code
    text = code + part
    # Twice is no name, be it definition and use or a repeated passage.
    for twice in (text.replace("below\n", f"below\nuse <- {key}\n"), text + part, text + "#" * 900 + part):
        spans = secret_scan.scan(twice, twice.encode())[1]
        assert [twice[s:e] for s, k, e in spans if k == 3] == [key, key]
    before = code + f"value <- {key}  # the staging secret\n" + code
    spans = secret_scan.scan(before, before.encode())[1]
    assert [before[s:e] for s, k, e in spans if k == 3] == [key]


def slow_candidates(text):
    """The definition: after each sensitive word, the strings that begin within its reach and after
    the last one taken; then the strings that end shortly before a word and were not taken."""
    found, done = [], 0
    words = list(secret_scan.SENSITIVE.finditer(text))
    for word in words:
        for m in secret_scan.CANDIDATE.finditer(text, max(done, word.end())):
            if m.start() >= word.end() + secret_scan.REACH:
                break
            found.append(m.span())
            done = m.end()
    taken = list(found)
    for m in secret_scan.CANDIDATE.finditer(text):
        near = [w.start() for w in words if w.start() >= m.end()]
        if near and near[0] - m.end() < secret_scan.REACH and not any(s < m.end() and m.start() < e for s, e in taken):
            found.append(m.span())
    return found


def test_candidates_against_their_definition():
    rng = np.random.default_rng(8)
    pieces = ["token", "secret", "pass", "x" * 15, "q8Zr5TnW2xKv9LmB", " ", "=", "\n", "a b ", "." * 60, "api_key_abcdefgh1234567"]
    for _ in range(400):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 40))))
        assert secret_scan._candidates(text) == slow_candidates(text)


def test_long_texts_are_scanned_in_proportion():
    import time

    for part in ("token ", "password = hunter22 and ", "secret_", "x" * 11 + " token "):
        text = part * (2_000_000 // len(part))
        began = time.process_time()
        secret_scan.scan(text, text.encode())
        assert time.process_time() - began < 20


def test_names_are_no_secrets_and_keys_are():
    names = ["AbstractSingletonProxyFactoryBean2", "handle_user_session_id_v2", "user_profile_settings_page_1",
             "c3p0_connection_pool_size", "com/example/app/v1/users/list", "2024-03-01T10-22-33Z", "getHTTPResponseCode2XX",
             "build-2024-11-05-release", "migration_0042_add_user_index", "libssl1-dev/bookworm"]
    for name in names:
        text = f"after the secret is in {name} we go on"
        assert not [s for s in secret_scan.scan(text, text.encode())[1] if s[1] == 3], name
    rng = np.random.default_rng(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    for alphabet, size, least in ((letters + letters[:26].upper(), 16, 0.95), (letters + letters[:26].upper(), 24, 0.95), (letters, 24, 0.9)):
        hits = 0
        for _ in range(200):
            key = "".join(rng.choice(list(alphabet), size - 1)) + "7"  # letters alone are not told from a name
            text = f"after the secret is in {key} we go on"
            hits += any(k == 3 and text[s:e] == key for s, k, e in secret_scan.scan(text, text.encode())[1])
        assert hits >= least * 200


# -- mixing --------------------------------------------------------------------------------------

@pytest.mark.parametrize("difficult_rows", [False, True])
def test_mixture(spark, folder, small, difficult_rows):
    rows = [(r[0], r[1], r[3]) for r in brute.document_rows()] if difficult_rows else [(d, t, s) for d, t, _, s in small]
    path = folder if difficult_rows else SMALL
    size = Counter()
    for _, text, source in rows:
        size[source] += len(brute.words(text))
    target = brute.targets(size)
    got = run(spark, "op9_", path)
    want = sorted(((d, len(brute.words(t)), size[s], round(target[s], 6)) for d, t, s in rows), key=order)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got), key=order) == want
    taken = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for source in size:
        whole = min(3, int((target[source] + 1e-6) // size[source])) if size[source] else 0
        reachable = 1
        for _, text, s in rows:
            reachable |= reachable << len(brute.words(text)) if s == source else 0
        rest = round(target[source]) - whole * size[source]
        best = (reachable & ((1 << (rest + 1)) - 1)).bit_length() - 1
        assert abs(taken[source] - whole * size[source] - best) <= 2
    assert sorted(map(tuple, run(spark, "op9_", path)), key=str) == sorted(map(tuple, got), key=str)


def test_budget_is_fitted():
    rng = np.random.default_rng(8)
    for _ in range(60):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 9)))
        counts = rng.integers(1, 5, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        for dp in (1 << 16, 40):
            take = mixing.fit_lengths(lengths, counts, budget, dp)
            assert (take >= 0).all() and (take <= counts).all()
            assert int((take * lengths).sum()) <= budget
    assert mixing.fit_lengths(np.array([3, 5]), np.array([4, 4]), 19, 1 << 16) @ np.array([3, 5]) in (18, 19)
    assert mixing.fit_lengths(np.array([1, 10]), np.array([50, 10**12]), 10**12 + 7, 1 << 16) @ np.array([1, 10]) == 10**12 + 7


def test_mixture_repeats_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    wanted = {r["doc_id"]: 1 if r["size"] == 0 else r["repeats"] for r in mixing.mixed(docs).collect()}
    mix = mixing.mixture(docs)
    assert mix.columns == docs.columns
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter({d: n for d, n in wanted.items() if n})


def test_mixture_repeats_rows_of_no_id(spark):
    """Rows share no repeats through a null, empty or repeated id."""
    rng = np.random.default_rng(3)
    rows = [(i if i % 3 else None, " ".join(["w"] * int(rng.integers(1, 9))) + f" {i}", f"s{i % 3}") for i in range(60)]
    rows += [(None, "a b c", "s0")] * 5 + [(7, "other text of the id", "s1"), (7, None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mixed(docs).collect()
    taken = Counter()
    for r in mixed:
        taken[r["source"]] += r["taken"]
    got = mixing.mixture(docs).collect()
    words = Counter()
    for r in got:
        words[r["source"]] += len(brute.words(r["text"]))
    assert words == taken
    assert sum(1 for r in got if r["text"] is None) == 1


# -- language identification ---------------------------------------------------------------------

def test_language_accuracy(spark):
    path = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    got = run(spark, "op10_", path)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) <= 0.01 * len(got)


def test_language_of_difficult_rows(spark, folder):
    text = difficult()
    for r in run(spark, "op10_", folder):
        letters = {any(map(str.isalpha, t or "")) for d, t in text if d == r["doc_id"]}
        if len(letters) == 1:
            assert (r["lang_pred"] in ("en", "fr")) == letters.pop()
        assert (r["lang_pred"] == "und") <= (r["score"] == 0 and r["rejected"])


def test_character_model_is_interpolated_kneser_ney():
    """Probabilities of the arrays against the formula, by language and order."""
    texts = {"x": ["abab cab", "abc"], "y": ["bbba", "cc ab"]}
    order_, rows = 3, []
    for lang in texts:
        codes, predicted, _ = lang_id.characters(texts[lang], order_)
        at = np.flatnonzero(predicted)
        rows += [(lang, tuple(codes[i - 2:i + 1].tolist())) for i in at]
    n = Counter(rows)
    grams = list(n)
    model = lang_id.fit(["x", "y"], np.array([g for _, g in grams], np.uint32),
                        np.array([("x", "y").index(x) for x, _ in grams]), np.array([n[g] for g in grams], float))
    alphabet = {g[-1] for _, g in grams}

    def counts(lang, k):
        if k == order_:
            return Counter({g: c for (x, g), c in n.items() if x == lang})
        return Counter(g[1:] for g in counts(lang, k + 1))

    def p(lang, gram):
        k = len(gram)
        if not k:
            return 1 / (len(alphabet) + 1)
        c = counts(lang, k)
        one, two = (sum(v == i for v in c.values()) for i in (1, 2))
        d = min(max(one / max(one + 2 * two, 1) if one else 0.5, 0.1), 0.95)
        after = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(lang, gram[1:])
        total = sum(after.values())
        return max(after.get(gram, 0) - d, 0) / total + d * len(after) / total * p(lang, gram[1:])

    for probe in ("abba", "cabcab", "zz a"):
        entropy, mixed, count, _ = model.entropies([probe])
        assert mixed[0] == pytest.approx(entropy[0].min())  # shorter than a stretch
        codes, predicted, _ = lang_id.characters([probe], order_)
        for j, lang in enumerate(("x", "y")):
            want = -sum(np.log(p(lang, tuple(codes[i - 2:i + 1].tolist()))) for i in np.flatnonzero(predicted))
            assert entropy[0, j] * count[0] == pytest.approx(want, rel=1e-5)


def test_unlike_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.trained(lang_id.training_part(docs))
    junk = ["Ж" * 300 + " щщщ " * 50, "qqxzj kkkwq zzxq " * 40, "12345 67", ""]
    assert model.predict(junk)[3] == [True] * 4
    kept = lang_id.drop_rejected(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_long_texts_take_no_place_in_the_sample(spark):
    """A language whose first-ranked text exceeds the bound, one with several long ones early, one of a long text alone."""
    words = {"x": "abba cabba ", "y": "lomo molo ", "z": "tiki kiti "}
    h = F.xxhash64(F.col("id").cast("string"))
    ranked = [r["id"] for r in spark.range(300).orderBy(h).select("id").collect()]
    rows = []
    for place, doc in enumerate(ranked):
        lang = "xy"[place % 2]
        size = 30_000 if place == 0 else 6_000 if lang == "y" and place < 8 else 40
        rows.append((doc, (words[lang] * size)[:size], lang))
    rows.append((1000, (words["z"] * 30_000)[:30_000], "z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.trained(docs, sample_chars=20_000)
    assert model.languages == ["x", "y", "z"]
    assert model.predict([words[x] * 9 for x in "xyz"])[0] == ["x", "y", "z"]
    # The texts after the long ones are calibrated on, too; the default spread stands for fewer than five.
    assert all(model.spread[i] < 1.0 for i in (0, 1))


# -- nearest neighbours --------------------------------------------------------------------------

def test_long_texts_keep_their_context_over_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = lang_id.trained(lang_id.training_part(docs))
    texts = [r["text"] or "" for r in docs.limit(60).collect()]
    long = [" ".join(texts) * 3, "  ,. " + texts[0] + " ... 123 " * 50 + texts[1], "", " " * 500]
    whole = model.entropies(long)
    for block in (1000, 777, 64):
        monkeypatch.setattr(lang_id, "BLOCK_CHARS", block)
        for a, b in zip(whole, model.entropies(long)):
            assert np.allclose(a, b, rtol=1e-6)


def vectors(seed=1, n=3000, size=24):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, size)).astype(np.float32)
    v[n // 2:n // 2 + n // 6] = v[7]  # many copies of one vector
    return v


def test_neighbours(spark, tmp_path):
    v = vectors()
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    bad = [(5000, None, 0), (5050, [0.0] * 24, 0), (5100, [float("nan")] * 24, 0), (5150, [None] * 24, 0),
           (5200, [float("inf")] + [1.0] * 23, 0), (None, rows[1][1], 0), (6000, [1.0, 2.0], 0), (6050, [2.0, 1.0], 0), rows[50]]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, shard int").repartition(4).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = defaultdict(dict)
    for r in run(spark, "op4_", str(tmp_path)):
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {*range(0, 3000, 50), 6000, 6050}
    assert [x[0] for x in got[6000].values()] == [6050] and got[6000][1][1] == pytest.approx(0.8)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(cosine, 12)))[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        for vec, score in got[q].values():
            assert score == pytest.approx(cosine[vec], abs=1e-12)
        hits += len({x[0] for x in got[q].values()} & set(best.tolist()))
    assert hits >= 0.9 * 300


def test_recall_on_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    got = defaultdict(set)
    for r in run(spark, "op4_", "/root/testdata/sf0.1"):
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = unit @ unit[q]
        cosine[q] = -2
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -cosine))[:5]].tolist()))
    assert hits >= 0.9 * 5 * len(got)


def _vectors(kind, dims, n=3000):
    rng = np.random.default_rng(dims)
    if kind == "even":
        return rng.normal(size=(n, dims))
    sizes = np.full(4, 0.25) if kind == "tight" else 1 / np.arange(1, 41)
    centres = rng.normal(size=(len(sizes), dims))
    return centres[rng.choice(len(sizes), n, p=sizes / sizes.sum())] + 0.2 * rng.normal(size=(n, dims))


@pytest.mark.parametrize("kind, dims", [("tight", 64), ("zipf", 64), ("even", 256), ("tight", 256)])
def test_recall_with_clusters_and_many_dimensions(spark, kind, dims):
    v = _vectors(kind, dims)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    vectors = permutation_index.usable(frame.repartition(4)).cache()
    got = defaultdict(set)
    for r in permutation_index.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=1500).collect():
        got[r["query_id"]].add(r["vec_id"])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cosine = unit[::20] @ unit.T
    cosine[np.arange(len(cosine)), np.arange(0, len(v), 20)] = -2
    best = np.argsort(-cosine, axis=1)[:, :5]
    hits = sum(len(got[20 * i] & set(row.tolist())) for i, row in enumerate(best))
    assert hits >= 0.94 * best.size


def test_agreement_is_the_footrule_distance():
    rng = np.random.default_rng(6)
    prefix = permutation_index.prefixes(rng.normal(size=(30, 8)), rng.normal(size=(12, 8)), 5)
    files = permutation_index.InvertedFiles(prefix, 12)
    for query in prefix[:5]:
        def rank(order, p):
            return list(order).index(p) if p in order else 5

        distance = [sum(abs(rank(query, p) - rank(other, p)) for p in range(12)) for other in prefix]
        assert [30 - 2 * a for a in files.agreement(query)] == distance


# -- pseudonyms ----------------------------------------------------------------------------------

def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


PRIVATE = [
    ("+1 (988) 555-2485", "phone"), ("988-555-2485", "phone"), ("+44 20 7946 0958", "phone"),
    ("4111 1111 1111 1111", "card"), ("378282246310005", "card"), ("123-45-6789", "ssn"), ("10.0.0.1", "ip"),
    ("255.255.255.255", "ip"), ("2021-02-28", "date"), ("28.2.2021", "date"), ("12/31/1999", "date"), ("1900-01-01", "date"),
    ("bob.42@mail8.example.com", "email"), ("a@x.io", "email"), ("Anne-Marie_7+tag@sub.host.org", "email")]
INVALID = ["4111 1111 1111 1112", "1234567890123456", "000-12-3456", "900-12-3456", "666-12-3456", "123-00-6789", "300.1.1.1",
           "01.2.3.4", "2021-02-30", "1899-01-01", "31/31/2000", "12345", "version 4.0", "555-12345"]


def test_pseudonyms_keep_their_format(spark):
    text = " ; ".join(v for v, _ in PRIVATE) + " | " + " ; ".join(INVALID) + " | " + PRIVATE[0][0] + " 9885552485x"
    docs = spark.createDataFrame([(1, text), (2, "again 1 988 555 2485, 4111111111111111."), (3, None), (4, "")], "doc_id long, text string")
    new = {r["doc_id"]: r for r in pii_feistel.pseudonymised(docs, "k").collect()}
    found = new[1]["pseudonyms"]
    assert [(p["value"], p["kind"]) for p in found] == [*PRIVATE, PRIVATE[0]]
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for p in found:
        assert p["pseudonym"] != p["value"]
        if p["kind"] not in ("ip", "date"):
            assert shape(p["pseudonym"]) == shape(p["value"])
        if p["kind"] == "card":
            assert luhn(re.sub(r"\D", "", p["pseudonym"]))
        if p["kind"] == "ip":
            assert all(0 <= int(x) < 256 and str(int(x)) == x for x in p["pseudonym"].split("."))
    assert all(v in new[1]["text"] for v in INVALID)
    # Equal values are linked, however they are written.
    digits = lambda s: re.sub(r"\D", "", s)
    second = [p["pseudonym"] for p in new[2]["pseudonyms"]]
    assert digits(second[0])[-10:] == digits(found[0]["pseudonym"])[-10:] == digits(found[-1]["pseudonym"])[-10:]
    assert digits(second[1]) == digits(found[3]["pseudonym"])
    assert (new[3]["text"], new[3]["pseudonyms"], new[4]["text"]) == (None, [], "")
    # The key gives the values back; another key gives other pseudonyms.
    back = {r["doc_id"]: r["text"] for r in pii_feistel.pseudonymised(
        spark.createDataFrame([(d, r["text"]) for d, r in new.items()], "doc_id long, text string"), "k", inverse=True).collect()}
    assert back[1] == text and back[2] == "again 1 988 555 2485, 4111111111111111."
    other = pii_feistel.pseudonymised(docs, "another key").where("doc_id = 1").first()
    assert all(a["pseudonym"] != b["pseudonym"] for a, b in zip(other["pseudonyms"], found))


WRITTEN = [  # a number, its digits without country code, its forms
    ("phone", 10, ["+1 (415) 555-0123", "+14155550123", "4155550123", "14155550123", "(415)5550123", "+1(415)5550123", "415-555-0123",
                   "415 5550123", "415555-0123", "1 (415) 555-0123"]),
    ("phone", 10, ["+1 (105) 055-0123", "+11050550123", "(105)0550123", "105.055.0123"]),
    ("phone", 10, ["+44 20 7123 4567", "+442071234567", "+44-2071234567", "+44 (0)20 7123 4567", "+4420 7123 4567"]),
    ("phone", 9, ["+420 601 123 456", "+420601123456", "+420-601-123456"]),
    ("card", 15, ["378282246310005", "3782-822463-10005", "3782 822463 10005"]),
    ("card", 13, ["4222222222222", "4222 2222 2222 2", "4222-2222-22222"]),
    ("card", 14, ["30569309025904", "3056 930902 5904", "3056 9309 0259 04"]),
    ("card", 16, ["4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111"]),
    ("card", 19, ["6205500000000000004", "6205 5000 0000 0000 004", "6205-5000-0000-0000-004", "620550 0000000000004"])]
UNMARKED = ["1700000000", "0.4155550123", "4155550123.5", "x4155550123", "2125550123_a", "+2101234567890", "99-12-2020"]


def test_all_written_forms_are_linked(spark):
    forms = [(i, v) for i, (_, _, vs) in enumerate(WRITTEN) for v in vs]
    # A card with its expiry, code, a date, a phone or an address behind it, as before.
    follow = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 12/25", "4111 1111 1111 1111 12/31/1999",
              "4111 1111 1111 1111 415-555-0123", "4111 1111 1111 1111 42@x.io", "3782 822463 10005 12/25"]
    texts = ["is " + v + "; " for _, v in forms] + ["on 31-12-2020, 1-2-1999."] + UNMARKED + follow
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    new = {r["doc_id"]: r for r in pii_feistel.pseudonymised(docs, "k").collect()}
    linked = defaultdict(set)
    for place, (i, value) in enumerate(forms):
        kind, n, _ = WRITTEN[i]
        found = [(p["kind"], p["value"]) for p in new[place]["pseudonyms"]]
        assert found == [(kind, value)], value
        p = new[place]["pseudonyms"][0]["pseudonym"]
        assert re.sub("[0-9]", "9", p) == re.sub("[0-9]", "9", value)
        linked[i].add(re.sub(r"\D", "", p)[-n:])
        assert kind != "card" or luhn(re.sub(r"\D", "", p))
    assert all(len(x) == 1 for x in linked.values())
    at = len(forms)
    assert [p["value"] for p in new[at]["pseudonyms"]] == ["31-12-2020", "1-2-1999"]
    assert all(re.fullmatch(r"\d{1,2}-\d{1,2}-\d{4}", p["pseudonym"]) for p in new[at]["pseudonyms"])
    assert [new[at + 1 + i]["text"] for i in range(len(UNMARKED))] == UNMARKED
    at += 1 + len(UNMARKED)
    card = next(iter(linked[7]))
    for i, text in enumerate(follow[:5]):
        assert re.sub(r"\D", "", new[at + i]["text"])[:16] == card
    assert [len(new[at + i]["pseudonyms"]) for i in range(6)] == [1, 1, 2, 2, 2, 1]
    back = pii_feistel.pseudonymised(spark.createDataFrame(
        [(d, r["text"]) for d, r in new.items() if d != len(forms)], "doc_id int, text string"), "k", inverse=True).collect()
    assert all(r["text"] == texts[r["doc_id"]] for r in back if "12/31" not in texts[r["doc_id"]])


@pytest.mark.parametrize("left,right", [(17, 4297), (10, 10), (1, 7), (898, 3)])
def test_feistel_is_a_permutation(spark, left, right):
    n = left * right
    values = spark.range(n).select("id", pii_feistel.feistel(F.col("id"), "t", left, right, "k").alias("p"))
    values = values.select("id", "p", pii_feistel.feistel(F.col("p"), "t", left, right, "k", True).alias("back")).collect()
    assert sorted(r["p"] for r in values) == list(range(n))
    assert all(r["back"] == r["id"] for r in values)


def test_pseudonym_queries_run_no_python(spark):
    plan = QUERIES["op1_feistel_pseudonyms"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_private_data_of_given_documents(spark, small):
    got = {r["doc_id"]: r for r in run(spark, "op1_", SMALL)}
    for doc, text, *_ in small:
        values = re.findall(r"\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", text)
        values += [c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", text) if luhn(c)]
        assert not [v for v in values if v in got[doc]["text"]]
        if not values:
            assert got[doc]["text"] == text


# -- pipeline ------------------------------------------------------------------------------------

def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {d: (t, x, s) for d, t, x, s in small}
    steps = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < 4:
            assert out.columns == spark.read.parquet(f"{SMALL}/documents.parquet").columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        steps.append(docs.collect())
    ids = [Counter(r["doc_id"] for r in s) for s in steps]
    assert len(ids[0]) >= 0.98 * len(small)
    rows = [(d, before[d][0]) for d in ids[0]]
    assert ids[1] == Counter({g[0]: 1 for g in brute_groups(rows) if g[3]})
    rows = [(d, before[d][0]) for d in ids[1]]
    near = brute.near(rows, 5, 80)
    assert ids[2] == Counter({d: 1 for d, (_, component) in near.items() if component == d})
    size = Counter()
    for d in ids[2]:
        size[before[d][2]] += len(brute.words(before[d][0]))
    taken = Counter()
    for d, n in ids[3].items():
        taken[before[d][2]] += n * len(brute.words(before[d][0]))
    target = brute.targets(size)
    assert all(abs(taken[s] - target[s]) <= max(len(brute.words(before[d][0])) for d in ids[2] if before[d][2] == s) for s in size)
    assert ids[4] == ids[3]
    tokenizer = chunk_bpe.load_tokenizer(chunk_bpe.default_path())
    for r in steps[4][:40]:
        assert (r["n_tokens"], list(r["ids"])) == (len(r["ids"]), direct(tokenizer, before[r["doc_id"]][0])[0])


def test_pipeline_takes_difficult_rows(spark, folder, empty):
    assert corpus_pipeline.run(spark, folder).count() > 5
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_written_tables_keep_their_schema(spark):
    df = spark.createDataFrame([], "a long, b array<string>")
    assert written(df, "test").schema == df.schema
