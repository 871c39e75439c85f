"""Importance resampling, conversation repair and language identification against brute force."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from sparkgauge.llm import conversation_repair as repair
from sparkgauge.llm import importance, lang_id

R = random.Random(23)
WORDS = ["the", "Of", "stone", "river", "Haus", "für", "niño", "x1", "日本", "Ünder", "don't", "tea,", "42", "É"]


def prose(n, words=WORDS):
    return " ".join(R.choice(words) + ("\n" if R.random() < 0.05 else "") for _ in range(n))


ODD = ["", None, " \t\n", "a", "!!! ???", "\x00\x01", "A" * 5000, "ab " * 3000, "ΑΣ. İ é", "👩‍👩‍👧 🎉", "ẞ Ǆ ﬁ ½ ² ١٢", "the " * 19, "the " * 20]
TEXTS = [*ODD, *(prose(R.randint(1, 120)) for _ in range(40))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], len(t or ""), -1, 0.5) for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[20], "en", None, None, None), (None, TEXTS[21], "de", 1, 2, 0.1), rows[25], rows[25]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, rank int, score double").repartition(3).cache()


# ---- importance resampling


def features(text, n):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [" ".join(words[i : i + k]) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def resampled_by_hand(rows, target, share, n, buckets, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw, aim = (collections.Counter(bucket(f) for t in texts for f in features(t, n)[1]) for texts in ([t for _, t in rows], target))
    S, T = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1.0) * (S + buckets) / ((raw[b] + 1.0) * (T + buckets))))
    out = []
    for doc_id, text in rows:
        words, found = features(text, n)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    can = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(can[: len(can) * share // 100], 1):
        r[4] = k
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("share, n, buckets, least", [(10, 1, 10_000, 20), (60, 3, 97, 5), (100, 2, 10_000, 0)])
def test_resampling(spark, docs, monkeypatch, share, n, buckets, least):
    monkeypatch.setattr(importance, "SLICE", 50)  # so that runs of words go over the ends of slices
    target = [None, "the stone of the river", prose(30), "für für niño"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.resampled(docs, items, share, n, buckets, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = resampled_by_hand([(r.doc_id, r.text) for r in docs.collect()], target, share, n, buckets, least)
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_resampling_of_nothing(spark, docs):
    none = docs.where("false")
    assert importance.resampled(none, docs).count() == 0
    assert all(r.n_features == r.weight == 0 and r["rank"] is None for r in importance.resampled(docs.where("text is null"), none).collect())


def test_drawn_rows_are_whole(docs, spark):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = importance.drawn(unique, docs, share=30)
    ids = {r.doc_id for r in importance.resampled(unique, docs, share=30).where("rank is not null").collect()}
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == ids and ids


def test_ring_is_the_hash_of_every_run():
    words = [w.encode() for w in prose(50).split()]
    for n in (1, 2, 5):
        ring = importance.Ring(n)
        got = ring.hashes(words[:20]) + ring.hashes(words[20:])
        want = [zlib.crc32(b" ".join(words[i - k : i + 1])) for i in range(len(words)) for k in range(min(n - 1, i), -1, -1)]
        assert got == want


# ---- conversations


def cheapest(rows):
    """(cost, audit) by a search over all edits in order of cost and text; ``rows`` are (initial, must go, cut)."""
    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if (at, roles, audit) in seen or len(roles) > len(rows) + 3:
            continue
        seen.add((at, roles, audit))
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        following = "u" if roles in ("", "s") or roles[-1] == "a" else "a"
        heapq.heappush(heap, (cost + 3, audit + "I", at, roles + following))
        if at < len(rows):
            initial, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if not gone:
                if initial == following or initial == "s" and roles == "":
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", at + 1, roles + initial))
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", at + 1, roles + following))


def test_cheapest_edits_of_all_short_signatures():
    letters = ["s", "u", "a", "o", "S", "U", "A", "O", "x"]
    trie = repair.Trie()
    words = sorted("".join(w) for n in range(4) for w in itertools.product(letters, repeat=n))
    for word in words:
        want = cheapest([(c.lower(), c == "x", c.isupper()) for c in word])
        assert trie.solve(word) == want, word
    assert trie.steps == len(words) - 1  # a layer for each node of the trie, whatever goes through it


def test_cheapest_edits_of_random_signatures():
    trie = repair.Trie()
    for word in sorted("".join(R.choice("suaoSUAOx" if k % 2 else "uax") for _ in range(R.randint(4, 6))) for k in range(60)):
        assert trie.solve(word) == cheapest([(c.lower(), c == "x", c.isupper()) for c in word]), word


def test_long_signature_takes_seconds():
    cost, audit = repair.Trie().solve("ua" * 200_000 + "x")
    assert cost == 4 and audit == "K" * 400_000 + "D"


def by_hand(rows):
    """Every conversation, from the rules."""
    out, groups = [], collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = groups[conv]
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        own += [(turn, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text)] * (2 if fate == 3 else 1)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = {r[0] for r in own} - {None}
        seen, faults, signature = set(), collections.Counter(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            signature.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = cheapest(signature)
        repaired, roles, at = [], "", 0
        for op in audit:
            needed = "user" if roles in ("", "s") or roles[-1] == "a" else "assistant"
            new = {"I": lambda: (needed, ""), "K": lambda: own[at][2:], "R": lambda: (needed, own[at][3]), "D": lambda: None}[op]()
            if new:
                repaired.append(new)
                roles += new[0][0]
            at += op != "I"
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def talks(spark):
    roles, said = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No!", "Why?", "and then", "  ", "", None, "Yes.", "a\nb.", "x. \t\n\x0b"]
    rows = []
    for conv in range(60):
        alternating = R.random() < 0.5
        for turn in range(R.randint(1, 6)):
            rows.append((conv, turn + (R.random() < 0.1), roles[turn % 2] if alternating else R.choice(roles), f"{conv} {turn}." if alternating else R.choice(said)))
    rows += [(None, None, "user", "a."), (None, 1, None, None), (None, 2, "assistant", "b"), (7, None, "system", "s."), (8, None, "system", "s."), (61, 0, "user", "same."), (61, 0, "user", "same."), (62, 5, "user", "x" * 300_000)]
    return spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int").repartition(4).cache()


def test_repairs(spark, talks):
    got = repair.repairs(repair.damaged(talks))
    want = by_hand([tuple(r)[:4] for r in talks.collect()])
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {t for n, t in got.dtypes if n not in ("audit", "repaired_sha256")} == {"bigint"}
    assert repair.repairs(repair.damaged(talks.where("false"))).count() == 0


def test_conversation_without_rows(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(lost, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.repairs(repair.damaged(one)).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_follow_the_pattern(spark, talks):
    got = collections.defaultdict(list)
    for r in repair.repaired(repair.undamaged(talks)).collect():
        got[r.conv_id].append((r.place, r.role, r.text))
    assert got
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and re.fullmatch("(s?(ua)+)?", "".join(r[1][0] for r in rows))


# ---- languages


def ways(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in ways(word[k:], pieces):
                yield [word[:k], *rest]


PIECES = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "▁a", "a", "b", "ab", "abb", "ba", "▁ab", "bb", "c", "abbac"]


def test_forward_sums_all_segmentations():
    pieces = lang_id.Pieces(PIECES)
    rng = np.random.default_rng(3)
    logs = np.log(rng.dirichlet(np.ones(len(PIECES)), 3))
    words = ["a", "b", "abba", "abbacab", "cabba", "aébb", "é", "bbbbbbbb", "日"]
    for places, cells, spelled in pieces.batches(words):
        table = lang_id.with_spelled(logs, spelled)
        got, parts = lang_id.forward(cells, table)[:, -1], lang_id.expected(cells, table[:1])
        for row, k in enumerate(places):
            known = {p: np.exp(logs[:, i]) for p, i in pieces.ids.items()} | {c: np.prod([np.exp(logs[:, pieces.bytes[b]]) for b in c.encode()], 0) for c in words[k] if c not in pieces.ids}
            found = [(w, np.prod([known[p] for p in w], 0)) for w in ways("▁" + words[k], known)]
            total = sum(p for _, p in found)
            assert np.allclose(np.exp(got[:, row]), total)
            assert np.isclose(parts[row].sum(), sum(len(w) * p[0] for w, p in found) / total[0])


def test_long_words_do_not_underflow():
    pieces = lang_id.Pieces.of(public_tokenizers.path("piece_bpe_32k.model"))
    (_, cells, spelled), = pieces.batches(["ab" * 5000])
    logs = lang_id.with_spelled(np.full((1, pieces.size), -10.0), spelled)
    assert np.isfinite(lang_id.forward(cells, logs)).all() and np.isfinite(lang_id.expected(cells, logs)).all()


def test_language(spark, docs, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    en, de = "the river and the stone were here with them".split(), "der Fluss und die Straße waren hier mit ihnen".split()
    rows = [(i, prose(R.randint(4, 60), en if i % 2 else de), "en" if i % 2 else "de", "x", 1.0) for i in range(200)]
    rows += [(1000 + i, t, None, "y", None) for i, t in enumerate(TEXTS)] + [(None, "the stone", "en", "z", 0.0), (7, "die Straße", "de", "z", 0.0), (7, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(5)
    results = []
    for known, cells in ((lang_id.KNOWN_WORDS, lang_id.CELLS), (5, 100)):
        monkeypatch.setattr(lang_id, "KNOWN_WORDS", known)
        monkeypatch.setattr(lang_id, "CELLS", cells)
        got = lang_id.predicted(table, path).collect()
        results.append(sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, round(r.score, 9)) for r in got))
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
        truth = {i: lang for i, _, lang, *_ in rows if i is not None and i < 200 and i != 7}
        test = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(test) > 30 and all(r.lang_pred == truth[r.doc_id] for r in test)
        plain = {1000 + i for i, t in enumerate(TEXTS) if not any(c.isalpha() for c in t or "")}
        assert {r.doc_id for r in got if r.lang_pred == "und" and r.doc_id != 7} == plain
    assert results[0] == results[1]  # however many words a task remembers


def test_language_learns_from_the_folds_alone(spark):
    """Held-out rows, and rows without a language, change no prediction."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, f"{'wo der' if i % 2 else 'to the'} {i}", "de" if i % 2 else "en") for i in range(60)]
    out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    changed = [(i, t, "zz" if i in out else lang) for i, t, lang in rows] + [(i + 100, "to the", None) for i in range(9)]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in lang_id.predicted(spark.createDataFrame(x, "doc_id long, text string, lang string"), path).collect()} for x in (rows, changed))
    assert out and a == {i: v for i, v in b.items() if i < 100}


def test_language_of_nothing(spark, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert lang_id.predicted(docs.where("false"), path).count() == 0
    alone = lang_id.predicted(docs.withColumn("lang", docs.lang.substr(9, 0)).where("false").unionByName(docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "n_chars", "rank", "score")), path)
    assert {(r.lang_pred, r.score) for r in alone.collect()} == {("und", 0.0)}
