"""The corpus operators against brute force on small tables with odd rows."""

import base64
import collections
import hashlib
import html
import importlib.util
import random
import re
import string
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparkgauge.llm import bpe, bpe_codec, components, decontaminate, html_extract, quality_classifier, quality_rules, rans, rans_files, secret_scan, simhash, suffix_dedup, token_counts

R = random.Random(11)
WORDS = ["the", "of", "and", "stone", "river", "lamp", "Haus", "für", "niño", "don't", "I'LL", "x1", "—", "日本", "é", "tea,", "end."]


def prose(n, r=R):
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


ODD = ["", None, " \t\n", "a", "word", "<|endoftext|>x<|endoftext|>", "\x1c \x1d\x85  x", "a" * 5000, "=" * 3000 + "ab" * 2000, "ΑΣ ΑΣ. İ é", "👩‍👩‍👧 🎉", "\r\n \r\n  x\t", "'s 't I've", "ẞ Ǆ ﬁ ½ ² ١٢"]
TEXTS = [*ODD, *(prose(R.randint(1, 400)) for _ in range(40)), "".join(R.choice(string.printable) for _ in range(4000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), -1) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[20], None, None, None, None), (None, TEXTS[21], "x", "y", 1, 2), rows[25], rows[25]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(df):
    return collections.Counter(tuple(r) for r in df.collect())


def expected(docs, f):
    return collections.Counter((r.doc_id, *f(r.text or "")) for r in docs.collect())


# ---- tokens


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)

    def one(t):
        n = len(library.encode(t, add_special_tokens=False).ids)
        return len(t.encode()), n, n > 1024

    assert rows_of(token_counts.token_counts(docs, path)) == expected(docs, one)
    assert token_counts.token_counts(empty, path).count() == 0


def test_codec(docs, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(t):
        ids = library.encode_ordinary(t)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    assert rows_of(bpe_codec.round_trip(docs, path)) == expected(docs, one)
    assert bpe_codec.round_trip(empty, path).count() == 0
    back = bpe_codec.decode(bpe_codec.encode(docs, path), path)
    assert collections.Counter((r.doc_id, bytes(r.bytes)) for r in back.collect()) == collections.Counter((r.doc_id, (r.text or "").encode()) for r in docs.collect())


def test_both_merge_forms_agree_with_the_heap():
    v = bpe.Vocabulary.from_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = [bytes(R.choice(b"abcde \xc3\xa9=") for _ in range(R.randint(1, 60))) for _ in range(400)]
    flat, counts = bpe.encode_matrix(v, pieces)
    heap = [bpe.merge_long(v, v.byte_ids[np.frombuffer(p, np.uint8)]) if len(p) > 1 else v.byte_ids[[p[0]]] for p in pieces]
    assert flat.tolist() == [i for h in heap for i in h.tolist()] and counts.tolist() == [len(h) for h in heap]
    assert bpe.count_merged(v, pieces).tolist() == counts.tolist()


def test_id_files(spark, docs, empty, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    known = {}
    start = 0
    got = [tuple(r) for r in rans_files.file_round_trip(docs, path).collect()]
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    at = 0
    for doc_id, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
        ids = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts[doc_id]]
        assert (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
        known[doc_id] = known.get(doc_id, 0) + 1
    assert known == {k: len(v) for k, v in texts.items()}
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert rans_files.file_round_trip(empty, path).count() == 0
    monkeypatch.setattr(rans_files, "BLOCK", 3000)
    out = str(tmp_path / "files")
    rans_files.write_ids(docs, path, out, 2)
    every = [i for r in sorted(rans_files.read_ids(spark, out).collect(), key=lambda r: r.start) for i in np.frombuffer(r.ids, "<u4").tolist()]
    for first, last in ((0, 5), (2990, 3100), (4000, 4000), (0, len(every)), (len(every) - 3, len(every) + 9)):
        got = sorted(map(tuple, rans_files.read_range(spark, out, first, last).collect()))
        assert got == [*enumerate(every)][first:last]


@pytest.mark.parametrize("n", [0, 1, 7, 300, 70_000])
def test_rans_round_trip(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 70_000).astype(np.int64)
    table = rans.Table(*np.unique(ids, return_counts=True))
    block = rans.encode(table, ids)
    assert (rans.decode(table, block) == ids).all()
    _, _, segments, lanes, steps, _ = rans.HEAD.unpack_from(block)
    parts = [rans.decode(table, block, k) for k in range(segments)]
    assert np.concatenate(parts).tolist() == ids.tolist()
    for place in {0, n // 2, n - 1} - {-1} if n else ():
        k, begin = rans.segment_of(block, place)
        assert parts[k][place - begin] == ids[place]
    if n > 300:
        assert table.freq.sum() == 1 << rans.SCALE
        with pytest.raises(ValueError):
            rans.decode(table, block[:40] + bytes([block[40] ^ 1]) + block[41:])


# ---- repeated strings


def removed(texts, size=200):
    seen = collections.Counter(t[s : s + size] for t in texts for s in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - size + 1):
            if seen[t[s : s + size]] > 1:
                gone[s] += 1
                gone[s + size] -= 1
        flag = np.cumsum(gone[:-1]) > 0
        runs = int((np.diff(np.concatenate(([0], flag.astype(int)))) == 1).sum())
        out.append((len(t), int(flag.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~flag].tobytes()).hexdigest()))
    return out


def edited(x, r):
    y = list(x)
    for _ in range(r.randint(0, 3)):
        if y:
            y[r.randrange(len(y))] = "#"
    return "".join(y)


@pytest.mark.parametrize("pack, step, bits", [(2_000_000, 1 << 21, 64), (4000, 250, 64), (4001, 251, 6)])
def test_suffix_dedup(spark, empty, monkeypatch, tmp_path, pack, step, bits):
    """Also where first digests of a few bits equate nearly all: the second ones tell them apart."""
    r = random.Random(pack)
    base = ["".join(r.choice("abcdef é") for _ in range(r.randint(0, 1200))) for _ in range(25)]
    texts = [edited(r.choice(base), r) if r.random() < 0.6 else "".join(r.choice("xyzw") for _ in range(99)) + r.choice(base)[: r.randint(0, 500)] for _ in range(90)]
    texts += ["", None, "a" * 199, "b" * 200, "c" * 201, "d" * 900, "ab" * 300, "q" * 50 + "ab" * 200, texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    module = suffix_dedup
    if step < 1 << 20:  # workers import the module themselves: give them one with other sizes
        with open(suffix_dedup.__file__, encoding="utf-8") as f:
            code = f.read().replace("PACK = 2_000_000", f"PACK = {pack}").replace("STEP = 1 << 21", f"STEP = {step}").replace("BUCKET = 64_000_000", "BUCKET = 900").replace("BATCH_ENTRIES = 1 << 14", f"BATCH_ENTRIES = {bits}").replace("PACK, MANY_PACKS = 16_000_000", "PACK, MANY_PACKS = 9000").replace("FIRST, SECOND = np.uint64(2**64 - 1)", f"FIRST, SECOND = np.uint64(2**{bits} - 1)").replace("from .", "from sparkgauge.llm.")
        (tmp_path / f"small_steps{bits}.py").write_text(code)
        spark.sparkContext.addPyFile(str(tmp_path / f"small_steps{bits}.py"))
        spec = importlib.util.spec_from_file_location(f"small_steps{bits}", tmp_path / f"small_steps{bits}.py")
        module = sys.modules[f"small_steps{bits}"] = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
    got = {r[0]: tuple(r[1:]) for r in module.deduplicated(df).collect()}
    assert [got[i] for i in range(len(texts))] == removed([(t or "").encode() for t in texts])
    assert module.deduplicated(empty).count() == 0


@pytest.mark.parametrize("buckets", [1, 2, 7, 96, 100_000])
def test_buckets_of_sorted_keys(buckets):
    r = np.random.default_rng(buckets)
    for n in (0, 1, 5, 3000):
        key = np.unique(np.concatenate((r.integers(0, 2**64, n, np.uint64), np.array([0, 2**63, 2**64 - 1], np.uint64)[: min(n, 3)])))
        found, bounds = suffix_dedup.bucket_parts(key, buckets)
        of = [max(b for b in (int(k) * buckets >> 64, (int(k) * buckets >> 64) + 1) if (b << 64) // buckets <= int(k)) for k in key]
        assert [b for b, size in zip(found.tolist(), np.diff(bounds).tolist()) for _ in range(size)] == of
        assert bounds[-1] == len(key) and (np.diff(found) > 0).all()


def test_packs_as_one_batch():
    r = random.Random(3)
    packs = {p: {(r.randrange(9), r.randrange(2)): (r.random() < 0.2, r.choice([0, 5, 7])) for _ in range(r.randint(1, 6))} for p in range(8)}
    parts = []
    for entries in packs.values():
        keys = sorted(entries)
        key, check = np.array(keys, np.uint64).T
        many, value = zip(*(entries[k] for k in keys))
        parts.append((key, check, np.array(many), np.array(value, np.uint64)))
    got = suffix_dedup.one_batch(parts, np.repeat(np.arange(8), [len(p[0]) for p in parts]))
    want = {}
    for p, entries in packs.items():
        for k, (many, value) in entries.items():
            if k in want:
                value, first = value if value == want[k][1] else 0, want[k][2]
                want[k] = (True, value, first)
            else:
                want[k] = (many, value, p)
    assert {(int(k), int(c)): (bool(m), int(v), int(f)) for k, c, m, v, f in zip(*got)} == want


def test_digests_that_tell_equality():
    """By plain arithmetic, and for words whose digests modulo a power of two agree in many bits."""
    prime, data = int(suffix_dedup.PRIME), np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    for symbols, base in suffix_dedup.PROOFS:
        proof = suffix_dedup.Proof(data, symbols, base)
        assert all(pow(base, k, prime) != 1 for k in range(1, 401))
        for a, b in ((0, 200), (17, 417), (2500, 3000), (5, 5), (0, 3000)):
            assert proof.of(np.array([a]), np.array([b]))[0] == sum(int(symbols[data[i]]) * pow(base, i - a, prime) for i in range(a, b)) % prime
        assert (proof.of(slice(0, 2801), slice(200, None)) == proof.of(np.arange(2801), np.arange(200, 3001))).all()
    word = np.array([bin(i).count("1") & 1 for i in range(512)])
    for n in (128, 200, 256, 400):
        one, other = (suffix_dedup.proofs((97 + w[:n]).astype(np.uint8), np.array([0]), np.array([n])) for w in (word, 1 - word))
        parts = [(x >> s) & suffix_dedup.PRIME for x, s in zip((one[0] ^ other[0], one[0] ^ other[0], one[1] ^ other[1]), np.array([0, 31, 0], np.uint64))]
        assert all(int(x[0]) % 1024 for x in parts)


def test_repeats_within_words_of_two_letters(spark):
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(700))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, word[:256], other[:256], word[100:350]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.deduplicated(df).collect()}
    assert [got[i] for i in range(len(texts))] == removed([t.encode() for t in texts])


def test_levels_learn_from_all_batches():
    r = np.random.default_rng(4)
    family, seen = suffix_dedup.Levels(), collections.defaultdict(list)
    for pack in range(40):
        both = np.unique(r.integers(0, 600, r.integers(1, 60)).astype(np.uint64))
        key, check = both // 7, both % 7  # several checks for each key
        value = r.integers(1, 3, len(key)).astype(np.uint64)
        family.add(key, check, np.zeros(len(key), bool), value, np.full(len(key), pack))
        for k, v in zip(both.tolist(), value.tolist()):
            seen[k].append((pack, v))
    sizes = [len(level[0]) for level in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < 12
    keys = np.array(sorted(seen), np.uint64)
    many, value, first = family.look(keys // 7, keys % 7)
    assert many.tolist() == [len(seen[k]) > 1 for k in keys.tolist()]
    assert first.tolist() == [seen[k][0][0] for k in keys.tolist()]
    assert [int(v) for v in value] == [seen[k][0][1] if len({v for _, v in seen[k]}) == 1 else 0 for k in keys.tolist()]


# ---- near duplicates


def groups(ids, fps, most):
    label = list(range(len(fps)))
    for _ in range(len(fps)):
        before = label[:]
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= most:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    low = {}
    for i, k in zip(ids, label):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    return [low.get(k) for k in label]


@pytest.mark.parametrize("words, most, distinct", [(3, 2, False), (2, 8, True), (1, 0, False)])
def test_near_duplicates(spark, docs, empty, words, most, distinct):
    r = random.Random(words)
    copies = [(1000 + i, " ".join(w for w in prose(120, random.Random(i // 6)).split() if r.random() > 0.01)) for i in range(60)]
    every = [(x.doc_id, x.text) for x in docs.collect()] + copies
    df = spark.createDataFrame(every, "doc_id long, text string")
    fps = [int.from_bytes(simhash.fingerprint(t, words, distinct), "big") for _, t in every]
    want = collections.Counter((i, f"{f:016x}", g) for (i, _), f, g in zip(every, fps, groups([i for i, _ in every], fps, most)))
    assert rows_of(simhash.near_duplicates(df, words, most, distinct)) == want
    assert simhash.near_duplicates(empty, words, most, distinct).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("a b c", "b c a", "c a b", "a b c")]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > 4)
    assert int.from_bytes(simhash.fingerprint("A  b\tC\na B c"), "big") == want
    assert simhash.fingerprint("É x") == xxhash.xxh64_digest("É x", 42) and simhash.fingerprint(" ") == simhash.fingerprint(None) == bytes(8)


def clustered(seed, n=500):
    r = np.random.default_rng(seed)
    fps = r.integers(0, 2**63, 3, np.uint64)[r.integers(0, 3, n)]
    for _ in range(3):
        fps ^= np.where(r.random(n) < 0.7, np.uint64(1) << r.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(np.concatenate((fps, r.integers(0, 2**63, 50, np.uint64))))


def true_labels(fps, most):
    x, y = np.nonzero((np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most) & (fps[:, None] != fps[None, :]))
    return dict(zip(*components.forest(fps[x], fps[y])))


@pytest.mark.parametrize("most", [1, 2, 3, 4, 8])
def test_balls_lose_no_link(most):
    for seed in range(5):
        fps = clustered(seed)
        assert dict(zip(*components.forest(*simhash.ball_links(fps, most)))) == true_labels(fps, most)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_cutting_loses_no_link(monkeypatch, most):
    monkeypatch.setattr(simhash, "SMALL", 8)
    for seed in range(3):
        fps = clustered(seed)
        assert dict(zip(*simhash.cut_links(fps, most))) == true_labels(fps, most)


def test_many_unlike_rows_of_a_key_take_seconds():
    fps = np.unique(np.random.default_rng(3).integers(0, 2**63, 200_000, np.uint64))
    near = fps[:500] ^ np.uint64(5)
    began = time.process_time()
    a, b = simhash.linked(np.zeros(len(fps) + 500, np.uint64), np.unique(np.concatenate((fps, near))), 2)
    assert len(a) == 500 and time.process_time() - began < 20


def test_refined_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPREAD", 12)
    fps = clustered(9)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = simhash.links(df, 2).toArrow()
    a, b = (got.column(c).to_numpy().view(np.uint64) for c in ("a", "b"))
    assert dict(zip(*components.forest(a, b))) == true_labels(fps, 2)


@pytest.mark.parametrize("most, m", [(2, 3), (4, 3), (8, 4)])
def test_variants_and_refined_keys_lose_no_link(monkeypatch, most, m):
    monkeypatch.setattr(simhash, "SMALL", 20)
    fps = clustered(6)
    both = np.full((64, 64), len(fps) / 4.0)
    np.fill_diagonal(both, len(fps) / 2.0)
    parts = simhash.group_bits(len(fps), both, m)
    plan = simhash.Plan(tuple(sum(1 << (63 - i) for i in g) for g in parts), simhash.allocate(len(fps), both, parts, most)[1], most)
    assert sum(plan.thresholds) == most - m + 1
    every = [simhash.signatures(fps, plan)]
    once = simhash.refined(*every[0], [*plan.masks], most)
    every += [once[:3], simhash.refined(*once, most)[:3]]
    for key, fp, _ in every:
        order = np.argsort(key, kind="stable")
        a, b = simhash.linked(key[order], fp[order], most)
        assert dict(zip(*components.forest(a, b))) == true_labels(fps, most)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(5000, 5001 + i) for i in range(400)] + [(900, i) for i in range(901, 960)] + [(i, i + 1) for i in range(2000, 2040)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    a, b = (np.array([e[k] for e in edges if e[0] != e[1]]) for k in (0, 1))
    want = {n: n for n in {*a.tolist(), *b.tolist()}} | dict(zip(*(x.tolist() for x in components.forest(a, b))))
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- rules, leaks, secrets


def base_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    twice = {k for i, g in enumerate(grams) if n[g] > 1 for k in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(twice), len(w) < 50 or 100 * len(twice) > 50 * len(w)


def scores_by_hand(rows, good):
    """Log-likelihood ratio of words and pairs by the word, counted one by one."""
    size = quality_rules.BUCKETS

    def grams(t):
        h = [zlib.crc32(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        return [x % size for x in h], [(x * 31 + y) % size for x, y in zip(h, h[1:])]

    raw, target = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    for i, t in rows:
        for k, found in enumerate(grams(t)):
            raw[k].update(found)
            target[k].update(found if i in good else ())

    def gain(k, x):
        more = quality_rules.SMOOTH[k]
        return np.log((target[k][x] + more) / (raw[k][x] * target[k].total() / raw[k].total() + more))

    out = []
    for _, t in rows:
        found = grams(t)
        out.append(sum(gain(k, x) for k in (0, 1) for x in found[k]) / max(1, len(found[0])))
    return out


def test_quality_rules(spark, docs, empty, monkeypatch):
    shout = " ".join(random.Random(i).choice(WORDS).upper() + "!!!" for i in range(90))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 + i, prose(150, random.Random(i))) for i in range(30)] + [(6000, shout), (6001, "one\ntwo\none\n \n\n" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(5000 + i, 1) for i in range(30)] + [(6000, 0), (None, 1)], "doc_id long, quality int")
    got = quality_rules.quality(df, labels).collect()
    assert collections.Counter(tuple(r)[:7] for r in got) == collections.Counter((i, *base_rules(t or "")) for i, t in rows)
    weight = quality_rules.weights(df, labels)
    by_hand = collections.Counter((i, round(s, 9), not base_rules(t or "")[5] and s >= quality_rules.THRESHOLD) for (i, t), s in zip(rows, scores_by_hand(rows, {5000 + i for i in range(30)})))
    assert rows_of(quality_rules.judged(df, weight).selectExpr("doc_id", "round(score, 9)", "kept")) == by_hand
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 1)
    assert quality_rules.weights(df, labels) == weight
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[5000 + i] for i in range(30) if not base_rules(rows[-32 + i][1])[5]) and not kept[6000]
    assert not any(r.kept for r in got if r.base_failed) and len(weight) == 2 * quality_rules.BUCKETS
    assert quality_rules.quality(empty, labels).count() == 0
    assert quality_rules.weights(df, labels.where("false")) == [0.0] * (2 * quality_rules.BUCKETS)
    assert quality_rules.accepted(docs, labels).columns == docs.columns
    assert rows_of(quality_rules.accepted(df, labels).select("doc_id")) == collections.Counter((r.doc_id,) for r in got if r.kept)


def leaks(texts, items):
    out = collections.Counter()
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, t in texts:
        w = split(t)
        for k, item in items:
            q = split(item)
            best = 0
            for d in range(-len(q), len(w) + 1) if q else ():
                same = [0 <= d + j < len(w) and w[d + j] == q[j] for j in range(len(q))]
                width = min(13, len(q))
                least = width if len(q) < 8 else -(-8 * width // 10)
                if any(sum(same[s : s + width]) >= least for s in range(len(q) - width + 1)):
                    best = max(best, sum(same))
            if best:
                out[i, k, best, len(q)] += 1
    return out


def test_decontamination(spark, docs, empty, monkeypatch):
    r = random.Random(8)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(n))) for k, n in enumerate((3, 8, 12, 13, 20, 40))] + [(99, None), (98, ""), (97, "w5"), (3, " ".join(vocabulary[:9]))]
    texts = []
    for i in range(80):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if i % 2:
            part = (r.choice(items[:6])[1]).split()
            a = r.randrange(max(1, len(part) - 13))
            part = part[a : a + r.randint(8, 40)]
            for _ in range(r.randint(0, 3)):
                part[r.randrange(len(part))] = "zzz"
            at = r.randrange(len(w) + 1)
            w[at:at] = part
        texts.append((i, ", ".join(w).upper() if i % 3 else " ".join(w)))
    texts += [(None, items[4][1]), (500, None), (501, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", docs.sparkSession.range(1).select("id").first().id + F_lit(7))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = leaks(texts, items)
    assert rows_of(decontaminate.overlaps(df, bench)) == want and len(want) > 10
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 3)
    assert rows_of(decontaminate.overlaps(df, bench)) == want
    assert decontaminate.without_leaks(df, bench).count() == len(texts) - len({k[0] for k in want})
    monkeypatch.setattr(decontaminate, "BROADCAST_IDS", 1)
    shared = spark.createDataFrame([(1, items[4][1]), (1, "clean words"), (None, items[5][1]), (None, "x"), (None, None)], "doc_id long, text string")
    assert {(x.doc_id, x.text) for x in decontaminate.without_leaks(shared, bench).collect()} == {(1, "clean words"), (None, "x"), (None, None)}
    assert rows_of(decontaminate.overlaps(shared, bench)) == leaks([(r.doc_id, r.text) for r in shared.collect()], items)
    assert decontaminate.overlaps(empty, bench).count() == 0 and decontaminate.without_leaks(df, bench.where("false")).count() == len(texts)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def accepted_changes(n):
    """Every choice of replaced tokens that the check at the hits accepts in an item of n tokens."""
    from itertools import combinations

    most = n - (n if n < 8 else -(-8 * n // 10))
    return [gone for k in range(most + 1) for gone in combinations(range(n), k)]


@pytest.mark.parametrize("n", range(1, 14))
def test_masks_survive_every_accepted_change(n):
    shown = [[i for i, c in enumerate(m) if c == "1"] for m in decontaminate.masks_of(n)]
    for gone in accepted_changes(n):
        assert any(not {at + k for k in m} & {*gone} for m in shown for at in range(n - m[-1]))


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_every_accepted_change_is_found(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    items = [(n, " ".join(f"t{n}x{k}" for k in range(n))) for n in range(1, 16)]
    texts, want = [], set()
    for n, item in items:
        for gone in accepted_changes(min(n, 13)):
            words = ["other" if k in gone else w for k, w in enumerate(item.split())]
            texts.append((len(texts), "before it " * (len(texts) % 2) + " ".join(words) + " and after" * (len(texts) % 3)))
            want.add((texts[-1][0], n))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontaminate.overlaps(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    found.sort()
    kinds = [k for _, k, _ in found]
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
    return kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed.encode()).hexdigest()


def test_secrets(spark, docs, empty):
    r = random.Random(1)
    bits = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", "paſſword", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é", "İ", "x", "abcdef", "\n", "9" * 22]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(x.doc_id, x.text) for x in docs.collect()], "doc_id long, text string")
    got = secret_scan.scan(df)
    assert rows_of(got.drop("spans")) == expected(df, base_spans)
    assert secret_scan.scan(empty).count() == 0
    assert secret_scan.redact(docs).schema == docs.schema and secret_scan.redact(docs).count() == docs.count()


def test_checksums_decide():
    body = "a1B2" * 7 + "zz"
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = secret_scan.BASE62[d] + digits
    good = f"ghp_{body}{digits:0>6}"
    scanner = secret_scan.Scanner()
    text = f"x {good} y {good[:-1]}{'1' if good[-1] != '1' else '2'} z"
    assert scanner.listed(scanner.spans(text)) == f"hosting:2:{2 + len(good)}"
    head = base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("=")
    assert [scanner.kinds[i].name for _, i, _ in scanner.spans(f"{head}.e30.abc eyJxx.yy.zz")] == ["signed"]
    assert scanner.redacted(f"a {good} b", scanner.spans(f"a {good} b")) == "a [hosting] b"


def signed(header):
    return base64.urlsafe_b64encode(header).decode().rstrip("=") + ".e30.abc"


@pytest.mark.parametrize("letters", [100, 9_000, 300_000])
def test_signed_token_with_a_header_of_any_length(letters):
    token, scanner = signed(b'{"alg":"HS256","kid":"' + b"k" * letters + b'"}'), secret_scan.Scanner()
    assert [(scanner.kinds[i].name, a, b) for a, i, b in scanner.spans(f"see {token} here")] == [("signed", 4, 4 + len(token))]


def test_added_kinds():
    scanner = secret_scan.Scanner()

    def kinds(t):
        return [(scanner.kinds[i].name, t[a:b]) for a, i, b in scanner.spans(t)]

    body = "Zz9" * 10
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = secret_scan.BASE62[d] + digits
    package = f"npm_{body}{digits:0>6}"
    assert kinds(f"({package}) {package}x {package[:-1]}") == [("package", package)]
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END RSA PRIVATE KEY-----"
    assert kinds(f"a {key} b -----BEGIN PRIVATE KEY----- none") == [("private", key)]
    good = signed(b'{"alg":"HS256"}')
    assert kinds(f"{good} {signed(b'[1]')} {signed(b'{"typ":"alg"}')} eyJ.{good} eyJx.{good}") == [("signed", good)] * 3
    assert kinds(signed(b'{"a":"alg"}')) == kinds(signed(b'{"alg":1}')) == []


@pytest.mark.parametrize("text", [signed(b'{"a":' + b"[" * 100_000), signed(b'{"a":' + b"[" * 3000), "eyJ" * 1_700_000, "eyJ." * 1_200_000, "eyJa.eyJ" * 600_000, "-----BEGIN " * 400_000, "-----BEGIN " + "A" * 3_000_000, "token " * 800_000, "token=" * 800_000, "a" * 5_000_000, "AKIA" * 1_200_000, "ghp_" * 1_200_000])
def test_hostile_texts_take_seconds(text):
    scanner, began = secret_scan.Scanner(), time.process_time()
    spans = scanner.spans(text)
    assert all(scanner.kinds[i].name in ("hex", "access", "assign") for _, i, _ in spans) and time.process_time() - began < 15


# ---- pages, classifier

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style></head><body><div id="cookie-banner">We use cookies</div>
<nav><ul><li><a href="/">Home</a><li><a href="/x">More</a></ul></nav>
<div class="layout"><div class="main-text"><h1>Title {i} &amp; co</h1><p>First {i}<br>line &copy; <b>bold</b>.
<p>Second   <i>{i}</i> par&#97;graph<script>var x = "</p>";</script></p>{extra}<blockquote>Quote {i}</blockquote></div><div class="sidebar"><p>Other news {i}</p></div></div>
<form><label>Mail</label></form><section class="comments"><p>Great post {i} indeed, I have so much to say about this one and that one</p></section><footer>&copy; site {i}</footer>"""


def test_html(spark, monkeypatch):
    pages = [(i, f"https://Host.example:80/{i}", PAGE.format(i=i, extra="<ul><li>one {0}</li><li>two</li></ul>".format(i) if i % 2 else "")) for i in range(12)]
    pages += [(100, None, None), (101, "nonsense", ""), (102, "http://a.b", "plain &lt; text"), (103, "http://a.b", "<p>" * 3000 + "deep" + "<"), (0, "https://host.example/0", pages[0][2])]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string").repartition(5)
    got = html_extract.main_text(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    for r in got:
        if r.page_id < 100:
            i = r.page_id
            more = [f"one {i}", "two"] if i % 2 else []
            assert r.text.split("\n") == [f"Title {i} & co", f"First {i} line © bold.", f"Second {i} paragraph", *more, f"Quote {i}"]
    texts = {r.page_id: r.text for r in got}
    assert (texts[100], texts[101], texts[102]) == ("", "", "plain < text") and texts[103].startswith("deep")
    assert html_extract.main_text(df.where("false")).count() == 0
    monkeypatch.setattr(html_extract, "BROADCAST_CHARS", 0)
    assert rows_of(html_extract.main_text(df)) == collections.Counter(tuple(r) for r in got)


ARTICLE = """<html><body><header><a href="/">Site</a></header><div class="alert">Old browser {i}</div><main><article class="post"><header class="entry-header"><h1>T{i}</h1></header>
<p class="byline">By {i}</p><div class="entry-content"><p>One {i}</p><h2>Background</h2><p>Two {i}</p><table><tr><td>c{i}<td>d</table><div class="ad-slot">Buy {i}</div></div>
<ol class="comment-list"><li>Nice {i}</ol></article><aside>More {i}</aside></main></body></html>"""


def test_article_with_header_and_comments():
    pages = [ARTICLE.format(i=i) for i in range(8)]
    whole = None
    for p in pages:
        tree = html_extract.fold(html_extract.parse(p))
        whole = html_extract.merged(whole, tree) if whole else tree
    regions = html_extract.mark_regions(whole)
    assert html_extract.extract(pages[3], regions) == "T3\nBy 3\nOne 3\nBackground\nTwo 3\nc3\nd"


def test_wrapper_expression():
    trees = [html_extract.fold(html_extract.parse(p)) for p in ("<ul><li>a<li>b</ul>", "<h1>t</h1><ul><li>c</ul>")]
    assert html_extract.expression(html_extract.merged(*trees)) == "<#root>(<h1>#fixed</h1>)?<ul>(<li>#text</li>)+</ul></#root>"


def test_wrappers_of_equal_pages_take_any_order():
    pages = [html_extract.fold(html_extract.parse(PAGE.format(i=i, extra=""))) for i in range(6)]
    whole = pages[0]
    for p in pages[1:]:
        whole = html_extract.merged(whole, p)
    halves = html_extract.merged(html_extract.merged(pages[0], pages[1]), html_extract.merged(html_extract.merged(pages[2], pages[3]), html_extract.merged(pages[4], pages[5])))
    assert html_extract.expression(whole) == html_extract.expression(halves) and html.escape(html_extract.expression(whole))


def test_classifier(spark, docs, empty):
    good = [(i, prose(120, random.Random(i))) for i in range(300)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(120, random.Random(i)).split())) for i in range(150)]
    df = spark.createDataFrame(good + bad + [(None, "x"), (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1)], "doc_id long, quality int")
    got = quality_classifier.scored(df, labels).collect()
    assert len(got) == 453 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([(r.doc_id < 1000) == r.predicted for r in held if r.doc_id < 5000]) > 0.95
    assert {r.score for r in quality_classifier.scored(df, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.scored(empty, labels).count() == 0
    # every row again, pair by pair
    machine, make = quality_classifier.train(df, labels), quality_classifier.Features()
    score = {r.doc_id: r.score for r in got}
    for i, t in [*good[:40], *bad[:40], (5000, None), (5001, "")]:
        ids, x = make.of(t)
        pairs = sum(float(machine.factors[ids[a]] @ machine.factors[ids[b]]) * float(x[a] * x[b]) for a in range(len(ids)) for b in range(a))
        assert abs(score[i] - 1 / (1 + np.exp(-(machine.bias + float(machine.weights[ids] @ x) + pairs)))) < 1e-4


def test_classifier_sample_is_bounded_by_letters(spark, monkeypatch):
    rows = [(i, "good words here " * 20 if i % 2 else "BAD!! " * 40) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality_classifier, "fit", lambda found, marks: taken.append(len(found)))
    for letters in (150_000_000, 10_000, 0):
        monkeypatch.setattr(quality_classifier, "LETTERS", letters)
        quality_classifier.train(df, labels)
    outside = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))
    assert taken[0] == outside and 25 <= taken[1] <= 42 and taken[2] == 0
    monkeypatch.setattr(quality_classifier, "LETTERS", 150_000)
    long = spark.createDataFrame([(i, "x" * (200_000 if zlib.crc32(str(i).encode()) % 3 == 0 else 50)) for i in range(200)], "doc_id long, text string")
    quality_classifier.train(long, labels)  # whichever comes first, the short ones are taken
    assert taken[3] == sum(zlib.crc32(str(i).encode()) % 5 != 0 and zlib.crc32(str(i).encode()) % 3 != 0 for i in range(200))


def test_factorisation_identity():
    r = np.random.default_rng(0)
    m = quality_classifier.Machine(0.3, r.normal(size=9).astype(np.float32), r.normal(size=(9, 4)).astype(np.float32))
    ids, values = np.array([0, 3, 5, 1, 8]), r.normal(size=5).astype(np.float32)
    direct = []
    for part in (slice(0, 3), slice(3, 5)):
        i, x = ids[part], values[part]
        pair = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        direct.append(0.3 + m.weights[i] @ x + pair)
    assert np.allclose(m.parts(ids, values, np.array([0, 3]))[0], direct, atol=1e-5)
