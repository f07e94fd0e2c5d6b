"""Each operator against a brute-force version on a small fixture of awkward rows, and on an empty table."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundswell.llm import exact_dedup, fingerprints, language_id, mixing, near_dedup, packing, pii, quality, substring_dedup, suffix_tree_lm
from groundswell.llm.queries import word_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# The extra columns have names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash long, size long, row long, n long, label string, kept boolean, print long, chunk long, near_id int, mix_print int, kept_id int, kept_sha string"


def _texts():
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = say(120), say(90)
    near = []
    for k in range(12):  # near copies with a few words changed
        w = base.split(" ")
        for _ in range(1 + k % 5):
            w[r.randrange(len(w))] = r.choice(words)
        near.append(" ".join(w))
    mixed = [say(20) + "\n" + passage + " " + say(15), passage, "É " + passage.upper(), say(30) + passage[:420] + "é" + say(3)]
    odd = [None, "", "   \t\n", "one", "One", "two words", "two  words", "a\x1fb　c", "1234 !!", "x " * 700, "ab" * 900, say(6000), "a <|endoftext|> b<|STARTOFTEXT|>", "x\x01y \x01 z"]
    people = [
        "mail a.b@c.de and é.x@y.z, x@@y.com a@b.c@d.e, 1.2.3.4.5.6.7.8 or 256.1.1.1 tel +1 (017) 555-7713 +49.30.1234567",
        "card 4111 1111 1111 1111, 4111111111111112 4111-1111-1111-1111 5 5 5 +1+23456789012 00001.2.3.255 " + "7 " * 3000 + "9" * 5000,
    ]
    shared, sides = say(14), [(say(2), say(1)), (say(2), say(1))]  # what follows a passage depends on what comes before it
    sided = [f"{a} {shared} {b} {say(k % 4)}" for k in range(7) for a, b in sides]
    return [base, *near, base, base, *mixed, *mixed[:2], *odd, *people, say(40), say(41), *sided]


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    langs = ["en", "fr", None]
    made = [(k, t, langs[k % 3], [f"s{k % 4}", None][k % 7 == 6], len(t or "")) for k, t in enumerate(texts)]
    made += [made[3], made[3], (None, "text of no id " * 40, "en", None, None), (None, None, None, None, None)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 12) for r in rows], SCHEMA).repartition(3, "n_chars")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is None, v) for v in x)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_vocabulary())
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t, *_ in rows]
    got = packing.digest(docs, word_vocabulary(), window=256, piece=48, group_tokens=2000).collect()
    pieces = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    want = collections.Counter()
    for (i, *_), a in zip(rows, ids):
        at = 0
        while at < len(a):
            n = 256 if at + 256 <= len(a) else min(48, len(a) - at)
            want[i, at, n, zlib.crc32(a[at : at + n].tobytes()), len(a)] += 1
            at += n
    assert pieces == want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 256
    whole = packing.pack(docs, word_vocabulary(), window=256, piece=48, group_tokens=2000).collect()
    same([(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in whole], [(r["doc_id"], r["start"], r["ids_crc32"]) for r in got])
    assert packing.pack(empty, word_vocabulary()).count() == 0 and packing.digest(empty, word_vocabulary()).count() == 0


def test_vocabulary_is_the_plain_call(rows, monkeypatch):
    """Special tokens' strings, the mark, and words forgotten on the way: ids are those of the tokenizer as it is."""
    import pyarrow as pa

    r = random.Random(8)
    parts = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\x01", " \x01 ", "don't", "I'LL", "İ", "É", "e\u0301", "ﬁ", "x²", "12.5", "...", "a|b", "\n", "\t", " ", "　", "z\u0338", "ǅ", "猫", "🙂", "abc", "Straße"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(400)] + [t or "" for _, t, *_ in rows]
    for most in (packing.KNOWN_WORDS, 40):
        monkeypatch.setattr(packing, "KNOWN_WORDS", most)
        known = packing.Vocabulary(word_vocabulary())
        assert known.apart
        for a in range(0, len(texts), 50):
            ids, upto = known.encode(pa.array(texts[a : a + 50], pa.large_string()))
            for k, t in enumerate(texts[a : a + 50]):
                assert ids[upto[k] : upto[k + 1]].tolist() == known.plain.encode(t, add_special_tokens=False).ids


def test_another_tokenizer_is_called_plainly():
    import public_tokenizers
    import pyarrow as pa

    known = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    assert not known.apart
    ids, upto = known.encode(pa.array(["Hello  World.\n", "", "a <|endoftext|>"], pa.large_string()))
    assert ids.tolist() == [i for t in ("Hello  World.\n", "", "a <|endoftext|>") for i in known.plain.encode(t, add_special_tokens=False).ids] and upto[1] == upto[2]


def test_differencing_is_near_equal():
    r = random.Random(1)
    sizes = [r.randint(1, 384) for _ in range(900)]
    place, loads = packing.difference(sizes, 90)
    assert sum(loads) == sum(sizes) and loads.max() - loads.min() < 12
    assert np.bincount(packing.windows_of(sizes, 2048), weights=sizes).max() <= 2048
    assert packing.windows_of([5] * 7, 12).max() == 3  # two a window: capacity raises three windows to four


def test_quality(docs, rows, empty):
    got = quality.classify(docs).collect()
    assert len(got) == len(rows) and {r["keep"] for r in got} <= {True, False}
    assert all(0 <= r["score"] <= 1 and 0 <= r["weak_label"] <= 1 for r in got)
    assert quality.classify(empty).count() == 0


def test_quality_is_that_of_a_plain_loop(docs, rows):
    """Votes by pattern, EM and the scorer with dictionaries and loops; a document counts once in the fit."""
    import pyarrow as pa

    texts = pa.array([t or "" for _, t, *_ in rows], pa.large_string())
    s, words = quality.signals(texts)
    said = [tuple(v) for v in quality.votes(s, words[3]).tolist()]
    patterns = collections.Counter(said)
    post = {}
    for v in patterns:
        good, bad = v.count(quality.GOOD), v.count(quality.BAD)
        post[v] = min(0.98, max(0.02, (good + 0.5) / (good + 2.0 * bad + 1.0)))
    for _ in range(100):
        prior = sum(n * post[v] for v, n in patterns.items()) / sum(patterns.values())
        table = {}
        for k in range(8):
            for c in (0, 1):
                mass = {v: n * (post[v] if c else 1 - post[v]) for v, n in patterns.items()}
                for vote in (0, 1, 2):
                    table[k, c, vote] = (sum(m for v, m in mass.items() if v[k] == vote) + 0.5) / (sum(mass.values()) + 1.5)
        new = {}
        for v in patterns:
            good, bad = (math.log(x) + sum(math.log(table[k, c, vote]) for k, vote in enumerate(v)) for c, x in ((1, prior), (0, 1 - prior)))
            new[v] = 1 / (1 + math.exp(bad - good))
        done = max(abs(new[v] - post[v]) for v in post) < 1e-9
        post = post if done else new
        if done:
            break
    at, col, val = quality.features(s, words, 12)
    facts = [{} for _ in rows]
    for d, c, v in zip(at.tolist(), col.tolist(), val.tolist()):
        facts[d][c] = facts[d].get(c, 0.0) + v
    once = {(r[0], r[1]): k for k, r in enumerate(rows)}.values()  # rows equal in id and text are one
    weight, square, bias = collections.defaultdict(float), collections.defaultdict(lambda: 1e-8), [0.0, 1e-8]
    grid = range(1 << 12)
    for _ in range(300):
        grad, slope = collections.defaultdict(float), 0.0
        for d in once:
            z = sum(weight[c] * v for c, v in facts[d].items()) + bias[0]
            err = (1 / (1 + math.exp(-max(-30, min(30, z)))) - post[said[d]]) / len(once)
            slope += err
            for c, v in facts[d].items():
                grad[c] += err * v
        for c in {c for f in facts for c in f}:
            g = grad[c] + 1e-4 * weight[c]
            square[c] += g * g
            weight[c] -= 0.5 * g / math.sqrt(square[c])
        bias[1] += slope * slope
        bias[0] -= 0.5 * slope / math.sqrt(bias[1])
    assert len(grid) > max(c for f in facts for c in f)
    want = []
    for (i, *_), v, f in zip(rows, said, facts):
        score = 1 / (1 + math.exp(-(sum(weight[c] * x for c, x in f.items()) + bias[0])))
        want.append((i, post[v], score))
    got = sorted(((r["doc_id"], r["weak_label"], r["score"]) for r in quality.classify(docs).collect()), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 and abs(a[2] - b[2]) < 1e-4


def test_label_model_finds_accuracies():
    r = np.random.default_rng(2)
    truth = r.random(20_000) < 0.7
    seen = np.stack([np.where(r.random(20_000) < 0.4, 2, np.where(r.random(20_000) < a, truth, ~truth)) for a in (0.9, 0.8, 0.85, 0.7)], axis=1)
    patterns, counts = np.unique(seen, axis=0, return_counts=True)
    post, table = quality.label_model(patterns, counts.astype(float))
    right = table[:, 1, 1] / (table[:, 1, 0] + table[:, 1, 1])
    assert np.abs(right - [0.9, 0.8, 0.85, 0.7]).max() < 0.05
    assert abs((post * counts).sum() / counts.sum() - 0.7) < 0.05


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(rows, n):
    sets = [shingles(t, n) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least.setdefault(top(k), []).append(i)
    out = []
    for k, (i, *_) in enumerate(rows):
        ids = [x for x in least[top(k)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(sets[k]), c if sets[k] else i, i is not None and i == (c if sets[k] else i)))
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, rows, empty, n):
    same(near_dedup.find_near_duplicates(docs, words=n).collect(), linked(rows, n))
    assert near_dedup.find_near_duplicates(empty).count() == 0


def test_near_duplicates_across_hubs(spark):
    """Chains whose ends aren't similar, so that links are found where no hub is similar to all."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(12):
        text = [r.choice(words) for _ in range(150)]
        for _ in range(14):
            for _ in range(6):
                text[r.randrange(150)] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    r.shuffle(rows)
    got = near_dedup.find_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    same(got, linked(rows, 2))


def test_no_pair_within_the_distance_is_lost(spark):
    """Recall over all pairs of signatures: every pair within the distance shares a key, and passes the sketch."""
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 16, (40, 64), dtype=np.uint16)
    signs = [base]
    for differ in range(0, 36):
        more = base.copy()
        for row in more:
            at = r.choice(64, differ, replace=False)
            row[at] ^= r.integers(1, 1 << 16, differ, dtype=np.uint16)
        signs.append(more)
    sign = np.concatenate(signs)
    import pyarrow as pa

    plan = near_dedup._plan(64, 27, 1)
    keys = near_dedup._keys_of(pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in sign])], names=["sign"]), 64, plan)
    bits = ((sign & 1).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    within = 0
    for a in range(0, len(sign), 7):
        apart = (sign != sign[a]).sum(axis=1)
        near = np.flatnonzero(apart <= 27)
        within += len(near)
        assert (keys[near] == keys[a]).any(axis=1).all() and (np.bitwise_count(bits[near] ^ bits[a]) <= 27).all()
    assert within > 1000


@pytest.mark.parametrize("few", [1, 8, 1 << 18])
def test_components(spark, few):
    from groundswell.llm.components import components

    r = random.Random(7)
    links = [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5000), (7, None), (None, 8), (None, None)]
    links += links[:20] + [(b, a) for a, b in links[20:30]]
    group: dict = {}

    def top(k):
        while group.setdefault(k, k) != k:
            k = group[k]
        return k

    for a, b in links:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            group[b] = a
    got = components(spark.createDataFrame(links, "a long, b long").repartition(5), few=few).collect()
    assert sorted(map(tuple, got)) == sorted((k, top(k)) for k in list(group))
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_near_deduplicate_keeps_one(docs, rows, empty):
    got = near_dedup.deduplicate(docs, words=5).collect()
    assert got[0].asDict().keys() == set(docs.columns)
    left = linked([r[:2] for r in got], 5)
    groups = collections.Counter(c for (_, n, c, _) in left if n)
    alike = collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert max(groups.values()) <= max(alike.values())  # only rows equal in id and text stay together
    assert near_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("chunk, bucket", [(substring_dedup.CHUNK_BYTES, substring_dedup.BUCKET_ENTRIES), (3000, 64)])
def test_repeated_strings(docs, rows, empty, monkeypatch, chunk, bucket):
    """Against all strings; in one chunk and bucket, and in many."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "BUCKET_ENTRIES", bucket)
    said = [WORD.findall(t or "") for _, t, *_ in rows]
    where = collections.defaultdict(set)
    for d, w in enumerate(said):
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(d)
    passages = []
    for w in said:
        hit = np.zeros(len(w) + 1, int)
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                hit[k] += 1
                hit[k + 50] -= 1
        hit = np.cumsum(hit[:-1]) > 0
        passages.append((int((np.diff(hit.astype(int), prepend=0) == 1).sum()), int(hit.sum())))
    assert sum(p > (0, 0) for p in passages) > 5
    seen, texts = collections.Counter(), [(t or "").encode() for _, t, *_ in rows]
    for b in texts:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    want = []
    for (i, *_), b, found in zip(rows, texts, passages):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), *found))
    same(substring_dedup.remove_repeats(docs).collect(), want)
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11])
def test_difference_cover_has_each_difference(q):
    v = q * q + q + 1
    cover = substring_dedup.difference_cover(q)
    assert len(cover) == q + 1 and {(a - b) % v for a in cover.tolist() for b in cover.tolist()} == set(range(v))


def test_edited_fingerprints(docs, rows, empty):
    got = fingerprints.compare_edited(docs).collect()
    numbered = [r for r in rows if r[0] is not None]
    order = sorted(numbered, key=lambda r: r[0])
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order[:-1]):
        n = order[k + 1][1] or ""
        t = t or ""
        h = len(t) // 2
        assert by_id[i]["n_chars"] == len(t)
        if order[k + 1][0] != i:
            assert by_id[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest() or i == 3
    prints = {}
    for i, t, *_ in numbered:
        assert prints.setdefault(t or "", by_id[i]["fingerprint"]) == by_id[i]["fingerprint"]
    same([(r["doc_id"], r["fingerprint"]) for r in got], [tuple(r) for r in fingerprints.fingerprints(docs).collect()])
    assert fingerprints.compare_edited(empty).count() == 0


def test_edited_likeness_and_the_turn_at_the_end(spark):
    """Every row against the operator's parts on plain strings: the last document goes on with the first one."""
    import pyarrow as pa

    r = random.Random(21)
    texts = [" ".join(r.choice("abcdefghijk") for _ in range(r.randint(0, 60))) for _ in range(50)]
    frame = spark.createDataFrame([(7 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x for x in fingerprints.compare_edited(frame, per_bucket=9).collect()}
    mark = lambda t: fingerprints.fingerprint(pa.array([t], pa.large_string()), 2, 64, 18)
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        h = len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        x, a, b, c = got[7 * k], mark(t), mark(edited), mark(after)
        assert x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (x["fingerprint"], x["edited_fingerprint"]) == (fingerprints._hex(a)[0], fingerprints._hex(b)[0])
        assert abs(x["near_edited"] - fingerprints.likeness(a, b)[0]) < 1e-12 and abs(x["near_next"] - fingerprints.likeness(a, c)[0]) < 1e-12


def test_collision_rate_is_generalised_jaccard():
    import pyarrow as pa

    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(60)) for _ in range(30)]
    marks = fingerprints.fingerprint(pa.array(texts, pa.large_string()), 1, 1024, 12)
    for a in range(29):
        x, y = (collections.Counter(t.split()) for t in texts[a : a + 2])
        want = sum((x & y).values()) / sum((x | y).values())
        assert abs(fingerprints.likeness(marks[a : a + 1], marks[a + 1 : a + 2])[0] - want) < 0.08


def test_likeness_of_long_texts_is_not_inflated():
    import pyarrow as pa

    said = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    marks = fingerprints.fingerprint(pa.array([said(0, 100_000), said(100_000, 200_000), said(50_000, 150_000)], pa.large_string()), 2, 256, 12)
    assert fingerprints.likeness(marks[:1], marks[1:2])[0] < 0.02  # nothing in common
    assert abs(fingerprints.likeness(marks[:1], marks[2:])[0] - 1 / 3) < 0.1


def test_ranks_kept_change_no_fingerprint():
    import pyarrow as pa

    r = random.Random(6)
    texts = pa.array([" ".join(r.choice("abcdefghij") for _ in range(200)) + f" {k}" for k in range(40)], pa.large_string())
    assert (fingerprints.fingerprint(texts, 3, 64, 2) == fingerprints.fingerprint(texts, 3, 64, 14)).all()


def test_mixing(docs, rows, empty):
    got = mixing.taken(docs, block=64).collect()
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    by = collections.defaultdict(int)
    for r, n in zip(rows, sizes):
        by[r[3]] += n
    names = sorted(by, key=lambda s: (s is None, s))
    goals = dict(zip(names, mixing.targets([by[s] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))])))
    assert abs(sum(goals.values()) - sum(sizes)) < 1e-6 * sum(sizes) and all(goals[s] <= 3 * by[s] + 1e-6 for s in names)
    same([(r["doc_id"], r["size"], r["source_size"]) for r in got], [(r[0], n, by[r[3]]) for r, n in zip(rows, sizes)])
    taken = collections.defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["target"]] += r["taken"]
    assert sorted(map(round, taken)) == sorted({round(g) for g in goals.values()})
    for g, n in taken.items():
        assert abs(n - g * sum(1 for x in goals.values() if x == g)) < 2
    same(got, mixing.taken(docs.repartition(5), block=64).collect())
    full = mixing.mixed(docs, block=64)
    assert full.columns == docs.columns
    words = sum(len(WORD.findall(r["text"])) for r in full.collect())
    assert abs(words - sum(sizes)) < 2 * len(names) + 2
    assert mixing.taken(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_schedule_is_spread(spark):
    docs = spark.createDataFrame([(k, "w " * 50, f"s{k % 3}") for k in range(300)], "doc_id long, text string, source string")
    _, pieces = mixing.schedule(docs, weights=(1, 2, 3), block=50)
    slots = [s for _, s in sorted({(r["slot"], r["source_id"]) for r in pieces.collect()})]
    for n in (30, 120, 300):  # any run from the start is near the target mix
        for source, share in enumerate((1 / 6, 2 / 6, 3 / 6)):
            assert abs(slots[:n].count(source) - n * share) < 3


def test_lm_scoring(docs, rows, empty, monkeypatch):
    rows = [r for r in rows if "7 7 7" not in (r[1] or "")]  # contexts of 700 words are deep enough
    docs = docs.where(~F.coalesce("text", F.lit("")).contains("7 7 7"))
    tokens = [WORD.findall((t or "").translate(LOWER)) for _, t, *_ in rows]
    full = [["^", *ws, None] for ws in tokens]
    teach = [f for f, (i, *_) in zip(full, rows) if crc(i) % 10 != 0]
    c = collections.Counter(w for f in teach for w in f[1:])
    total = sum(c.values())
    p = [[(c[w] + 0.1) / (total + 0.1 * (len(c) + 1)) for w in f] for f in full]
    taught = [crc(i) % 10 != 0 for i, *_ in rows]
    twice, k, depths = {(d, j): 0 for d, f in enumerate(full) for j in range(1, len(f))}, 0, set()
    while twice:  # symbols whose context of length k is seen twice in training, and the shorter context's number
        k += 1
        counts, at, number = collections.defaultdict(collections.Counter), collections.defaultdict(list), {}
        for (d, j), shorter in twice.items():
            if j >= k:
                ctx = number.setdefault((shorter, full[d][j - k]), len(number))
                at[ctx].append((d, j))
                if taught[d]:
                    counts[ctx][full[d][j]] += 1
        twice = {}
        for ctx, own in counts.items():
            n, gain = sum(own.values()), 0.0
            if n < 2:
                continue
            twice |= dict.fromkeys(at[ctx], ctx)
            shorter = {full[d][j]: p[d][j] for d, j in at[ctx]}
            for w, x in own.items():
                q = math.exp(-1e-9 * math.exp(round(math.log(-math.log(shorter[w]) / 1e-9) * 200) / 200))
                gain += x * (math.log((x - 1 + n**0.75 * q) / (n - 1 + n**0.75)) - math.log(q))
            if gain > math.log(n):
                depths.add(k)
                for d, j in at[ctx]:
                    p[d][j] = (own[full[d][j]] + n**0.75 * p[d][j]) / (n + n**0.75)
    assert max(depths) > 14
    want = []
    for (i, *_), f in zip(rows, full):
        known = sum(c[w] > 0 for w in f[1:])
        root = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in f[1:])
        want.append((i, crc(i) % 10 == 0, len(f) - 1, known, total, root, sum(map(math.log10, p[len(want)][1:]))))
    want.sort(key=key)
    monkeypatch.setattr(suffix_tree_lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(suffix_tree_lm, "BUCKET_ENTRIES", 512)
    # However work is dealt out: classes of frequent contexts, windows from length 3 on, or pairs only.
    for how in ({}, {"frequent": 4, "near": 3, "window": 3}):
        got = sorted(map(tuple, suffix_tree_lm.score(docs, **how).collect()), key=key)
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-3 and abs(a[6] - b[6]) < 1e-3
    assert suffix_tree_lm.score(empty).count() == 0


def long_contexts():
    """Open symbols of texts with long repeats, after contexts of four symbols."""
    r = np.random.default_rng(8)
    passage, other = r.integers(0, 50, 900).tolist(), r.integers(0, 50, 40).tolist()
    texts = [[60] * 600, [60] * 500 + [61], passage, other + passage, other[3:] + passage[:400] + [62] + passage[401:], passage[:700] + [63]] * 2
    deep = suffix_tree_lm.Deep.__new__(suffix_tree_lm.Deep)
    sizes = np.array([len(x) for x in texts])
    deep.model, deep.number, deep.k = suffix_tree_lm.Model(10, 3, 1, 3, 1 << 20), 0, 4
    deep.codes, deep.prints, deep.sums = np.concatenate(texts), suffix_tree_lm.mix64(np.arange(1, 71, dtype=np.uint64)), [np.zeros(len(texts))] * 3
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    deep.at = np.flatnonzero(place >= 4)
    deep.place, deep.doc, deep.teaches = place[deep.at], np.repeat(np.arange(len(texts)), sizes)[deep.at], np.ones(len(deep.at), bool)
    deep.p = np.full(len(deep.at), 0.02)
    return deep.trimmed()


def test_long_contexts_share_the_text_they_send(monkeypatch):
    """A window for each entry would be as many symbols as entries times the window."""
    import pyarrow as pa

    deep = long_contexts()
    deep.k, width = 64, 512
    there = deep.place >= deep.k
    deep.at, deep.place, deep.doc, deep.teaches, deep.p = (x[there] for x in (deep.at, deep.place, deep.doc, deep.teaches, deep.p))
    sent = deep.entries(width)
    rows = deep.entry_rows(sent)
    text = sum(len(suffix_tree_lm.unplanes(x["text"], "<u8")) for x in rows)
    assert len(sent["keys"]) > 2000 and text < 0.06 * width * len(sent["keys"])
    p = {}
    for label in ("in stretches", "symbol by symbol"):
        p[label] = []
        for row in rows:
            got = suffix_tree_lm._grow(width)(None, pa.Table.from_pylist([row], schema=suffix_tree_lm.SENT)).to_pylist()[0]
            p[label] += [*suffix_tree_lm.unplanes(got["p"], "<f4").tolist(), *suffix_tree_lm.unplanes(got["flags"], "u1").tolist()]
        monkeypatch.setattr(suffix_tree_lm, "_alike", lambda *a: 0)
    assert p["in stretches"] == p["symbol by symbol"] and len(set(p["in stretches"])) > 10


def test_lm_scoring_of_chunks_of_one_document(spark):
    """A partition's only document, and a run of one word in which each context is longer than the one before."""
    texts = ["again " * 300 + "once", "again " * 300 + "once", "again " * 200 + "twice", "again " * 300 + "twice"]
    docs = spark.createDataFrame(list(enumerate(texts * 4, 1)), "doc_id long, text string")
    apart = sorted(map(tuple, suffix_tree_lm.score(docs.repartitionByRange(16, "doc_id")).collect()))
    together = sorted(map(tuple, suffix_tree_lm.score(docs.coalesce(1)).collect()))
    for a, b in zip(apart, together, strict=True):
        assert a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-3


def test_numbers_are_packed_without_transposing_them():
    """What is packed comes back; only the bytes that values need are kept, in less than half the time of a transposed copy."""
    for x, kind in (([], "<i8"), ([0, 0, 0], "<i4"), ([3, 255, 0], "<i8"), ([256, 1], "<i4"), ([-1, 1 << 40], "<i8"), ([1 << 63, 7], "<u8"), ([0.5, -2.0, 0.0], "<f4"), ([1e-300, 3.5], "<f8"), ([4, 0, 5], "u1")):
        x = np.array(x, kind)
        back = suffix_tree_lm.unplanes(suffix_tree_lm.planes(x, kind), kind)
        assert back.dtype == x.dtype and back.tolist() == x.tolist()

    def least(run):
        times = []
        for _ in range(7):
            begin = time.thread_time()
            run()
            times.append(time.thread_time() - begin)
        return min(times)

    x = np.arange(1 << 20) % 200
    assert least(lambda: suffix_tree_lm.planes(x)) < 0.5 * least(lambda: x.view(np.uint8).reshape(-1, 8).T.tobytes())


def test_keys_that_share_leading_bits_are_told_apart():
    """Keys and symbols that differ only in the bits that give way to places when they are sorted."""
    r = np.random.default_rng(11)
    few = r.integers(0, 1 << 63, 40, dtype=np.uint64) << np.uint64(1)
    for n in (0, 1, 2, 3, 5_000, 70_000):
        for symbols in (r.integers(0, 300, n), r.integers(0, 9, n).astype(np.uint64) + (np.uint64(1) << np.uint64(62)), few[r.integers(0, 40, n)]):
            for keys in (few[r.integers(0, 40, n)] + r.integers(0, 6, n).astype(np.uint64), r.integers(0, 1 << 63, n, dtype=np.uint64), np.full(n, (1 << 64) - 1, np.uint64)):
                order, found = suffix_tree_lm._sorted(keys)
                assert np.array_equal(order, np.argsort(keys, kind="stable")) and np.array_equal(found, keys[order])
                one, back = suffix_tree_lm._distinct(keys)
                _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                assert np.array_equal(one, first) and np.array_equal(back, inverse)
                order, found, theirs = suffix_tree_lm._order(keys, symbols)
                assert np.array_equal(np.sort(order), np.arange(n)) and np.array_equal(found, np.sort(keys))
                assert np.array_equal(found, keys[order]) and np.array_equal(theirs, symbols[order])
                assert int(suffix_tree_lm._starts(found, theirs).sum()) == (len(set(zip(keys.tolist(), symbols.tolist()))) if n else 0)
    hashed = np.arange(1 << 16, dtype=np.uint64) << np.uint64(40)  # more symbols in one context than their hash has free bits
    keys, twice = np.zeros(2 << 16, np.uint64), np.append(hashed, hashed)
    found = suffix_tree_lm._order(keys, twice)[2]
    assert int(suffix_tree_lm._starts(found).sum()) == 1 << 16


def test_word_hashes_are_of_all_bytes():
    """Words of one length or another, of zeros, beyond eight bytes and beyond those hashed together: a place in an array changes nothing."""
    import pyarrow as pa

    words = ["", "a", "b", "ab", "ba", "\0", "\0\0", "a\0", *("x" * n for n in range(7, 140)), *("x" * n + "y" for n in range(7, 140)), "é", "ü" * 40, "word", "words"]
    for kind in (pa.string(), pa.large_string()):
        names = pa.array(words, kind)
        hashes = suffix_tree_lm._hashes(names)
        assert len(set(hashes.tolist())) == len(words)
        assert suffix_tree_lm._hashes(pa.array(words[::-1], kind)).tolist() == hashes.tolist()[::-1]
        assert suffix_tree_lm._hashes(names[5:90]).tolist() == hashes.tolist()[5:90] and len(suffix_tree_lm._hashes(names[:0])) == 0


def test_closing_loses_no_state():
    """Of one symbol, no count between two and all gains more than both ends allow; of several, no subset does."""
    c = np.arange(2, 20_000)
    for p in 1 - np.logspace(-6, -0.01, 60):
        f = suffix_tree_lm.most_gain(c, np.full(len(c), p)) - np.log(c)
        assert f.max() <= max(f[0], f[-1], 0) + 1e-12
    r = np.random.default_rng(3)
    for _ in range(300):
        m = r.integers(1, 5)
        c, p = r.integers(1, 6, m).astype(float), r.dirichlet(np.ones(m + 1))[:m] * r.random() ** 0.2
        of = np.zeros(m, int)
        if not suffix_tree_lm.is_open(c, p, of, 1)[0]:
            for sub in np.stack(np.meshgrid(*[np.arange(x + 1) for x in c.astype(int)]), -1).reshape(-1, m).astype(float):
                some, n = sub > 0, sub.sum()
                if n >= 2:
                    gain = suffix_tree_lm.divergence(sub[some], p[some], np.full(int(some.sum()), n), np.zeros(int(some.sum()), int), 1)[0]
                    assert gain <= math.log(n)


def test_a_split_context_is_decided_as_one():
    """Classes' gains add up to the whole context's, and smoothed probabilities over all symbols to one."""
    r = np.random.default_rng(5)
    c = np.append(r.integers(1, 400, 50), 0).astype(float)
    p = r.dirichlet(np.ones(51))
    n = np.full(51, c.sum())
    whole = suffix_tree_lm.divergence(c, p, n, np.zeros(51, int), 1)[0]
    parts = suffix_tree_lm.divergence(c, p, n, np.arange(51) % 7, 7)
    assert abs(parts.sum() - whole) < 1e-6 * abs(whole)
    k = suffix_tree_lm.weight_of(c.sum())
    assert abs(((c + k * p) / (c.sum() + k)).sum() - 1) < 1e-12


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "card":
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or (all(int(x) <= 255 for x in value.split(".")) if kind == "ip" else 10 <= len(digits) <= 15)


def test_pii(docs, rows, empty):
    want = []
    for i, t, *_ in rows:
        spans = sorted((m.start(), n, kind, m.end()) for n, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, t or "") if valid(kind, m.group()))
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((i, *(sum(s[2] == k for s in spans) for k in PATTERNS), hashlib.sha256(said.encode()).hexdigest(), said))
    got = pii.report(docs)
    same([r[:6] for r in got.collect()], [w[:6] for w in want])
    base = collections.defaultdict(set)
    for w in want:
        base[w[0]] |= set(w[6].split(",")) - {""}
    for r in got.collect():
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in r["spans"].split(",") if s)]
        assert spans == sorted(spans) and (r["doc_id"] is None or base[r["doc_id"]] <= set(r["spans"].split(",")))
        assert r["n_spans"] == len(spans)
    assert pii.report(empty).count() == 0


def test_pii_adds_spans_that_the_rules_miss(spark):
    """Planted in their usual form for the rules to show the format, and in other forms for the trees to find."""
    r = random.Random(11)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexes = lambda: hashlib.sha1(digits(9).encode()).hexdigest()

    def card():
        body = digits(15)
        return next(body + d for d in "0123456789" if valid("card", body + d))

    rows, secrets, plain = [], {}, set()
    for k in range(400):
        said = f"some words {digits(2)} here"
        if k % 4 == 0:
            said += f' token = "{(key := hexes())}" and on'
            secrets[k] = (said.index(key), said.index(key) + 40)
        elif k % 4 == 1:
            said += f" pay {card()} now, or ask jo{k}@mail.example.com"
        elif k % 16 == 2:  # a key that no word announces
            said += f' found "{(key := hexes())}" and on'
            secrets[k] = (said.index(key), said.index(key) + 40)
        else:
            said += f" version 1.2 of {digits(5)}"
            plain.add(k)
        rows.append((k, said))
    got = {x["doc_id"]: x for x in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(f"secret:{a}:{b}" in got[k]["spans"].split(",") for k, (a, b) in secrets.items())
    assert caught >= 0.7 * len(secrets) and all(got[k]["n_spans"] == 0 for k in plain)


def test_boosting_learns_and_calibrates():
    cells = [((k % 4, a, 0, 0, b, 0, 0), 50, 48 if a > 5 and b < 3 else 1) for k in range(4) for a in range(10) for b in range(5)]
    trees = pii.boost(cells)
    least = pii.threshold(trees, cells, 0.95)
    chosen = [c for c in cells if pii.score_of(trees, c[0]) >= least]
    assert len(chosen) == 48 and all(c[2] == 48 for c in chosen)


def test_exact_duplicates(docs, rows, empty):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, top[t or ""], len(groups[t or ""]), i is not None and i == top[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows]
    same(exact_dedup.find_duplicates(docs).collect(), want)
    same(exact_dedup.find_duplicates(docs, capacity=3).collect(), want)
    same(exact_dedup.find_duplicates(docs, hashed=lambda c: F.length(c).cast("long")).collect(), want)  # colliding hashes
    assert exact_dedup.find_duplicates(empty).count() == 0
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    same([(r["text"] or "",) for r in kept.collect()], [(t,) for t in groups])
    assert exact_dedup.deduplicate(empty).count() == 0


def test_directory_doubles_until_buckets_fit():
    counts = {k: 1 + (k == 5) * 100 for k in range(16)}
    buckets = exact_dedup.directory(counts, 4, 4)
    assert sum(n for *_, n in buckets) == sum(counts.values())
    assert [n for p, d, n in buckets if n > 4] == [101]  # one key can't be split
    assert [p << (4 - d) for p, d, _ in buckets] == sorted(p << (4 - d) for p, d, _ in buckets)


def test_language_profiles(docs, rows, empty):
    profiles = language_id.learn(docs, size=40)

    def profile(texts, n):
        found = collections.Counter(g for t in texts for w in re.split(r"[\W\d_]+", (t or "").lower()) if w for g in language_id.grams(w, 3))
        return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))][:n]

    for lang in ("en", "fr"):
        assert profiles[lang] == profile([t for _, t, own, *_ in rows if own == lang], 40)
    got = {(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(docs, profiles, size=40).collect()}
    for i, t, *_ in rows:
        own = profile([t], 40)
        far = {lang: sum(min(40, abs(p.index(g) - k)) if g in p else 40 for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda x: (far[x], x))
        want = (i, best, round(1 - far[best] / (40 * len(own)), 9)) if own else (i, "und", 0.0)
        assert want in got
    assert language_id.learn(empty) == {} and language_id.predict(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, {}).collect()} == {"und"}
    kept = language_id.identified(docs, profiles, size=40, least=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(1 for _, t, *_ in rows if re.search(r"[^\W\d_]", t or ""))


def test_pipeline_stages(spark, docs, rows, empty, tmp_path):
    """Each stage on what the one before it kept, against plain Python."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    def kept(table):
        return sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=key)

    made = {}
    for start in (docs, empty):
        table = start
        for k, (name, stage) in enumerate(p.STAGES):
            out = stage(spark, table, "")
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{start is docs}-{name}")
            table = spark.read.parquet(f"{tmp_path}/{start is docs}-{name}")
            made[name] = table if start is docs else made[name]
        assert (table.count() > 0) == (start is docs)
    told = kept(made["language_id"])
    profiles = language_id.learn(docs)
    said = collections.Counter((r["doc_id"], r["lang_pred"] != "und" and r["score"] >= 0.02) for r in language_id.predict(docs, profiles).collect())
    assert collections.Counter(i for i, _ in told) == collections.Counter({i: n for (i, good), n in said.items() if good})
    assert all(re.search(r"[^\W\d_]", t) for _, t in told) and {t for _, t in told} == {r[1] for r in rows if re.search(r"[^\W\d_]", r[1] or "")}
    top = {}
    for i, t in told:
        top[t] = max(top.get(t, (False, 0)), (i is not None, i or 0))
    single = kept(made["exact_dedup"])
    assert single == sorted(((i if some else None, t) for t, (some, i) in top.items()), key=key)
    groups = linked([(i, t) for i, t in single], 5)
    apart = kept(made["near_dedup"])
    assert apart == sorted(((i, t) for (i, t), g in zip(single, groups) if g[0] == g[2]), key=key)
    assert len(apart) < len(single) < len(told)
    mix, sizes = made["mixing"].collect(), {r[0]: len(WORD.findall(r[1])) for r in apart}
    source = {r[0]: r[3] for r in rows}
    by = collections.Counter()
    for i, n in sizes.items():
        by[source[i]] += n
    names = sorted(by, key=lambda x: (x is None, x))
    goals = dict(zip(names, mixing.targets([by[x] for x in names], [(1, 2, 3)[k % 3] for k in range(len(names))])))
    words, uses = collections.Counter(), collections.Counter()
    for r in mix:
        words[r["source"]] += len(WORD.findall(r["text"]))
        uses[r["doc_id"]] += 1
    assert all(abs(words[x] - goals[x]) < 2 for x in names) and max(uses.values()) <= 3
    tok = Tokenizer.from_file(word_vocabulary())
    want = collections.Counter((r["doc_id"], len(tok.encode(r["text"], add_special_tokens=False).ids) + 1) for r in mix)
    pieces = made["packing"].collect()
    assert collections.Counter((r["doc_id"], r["doc_tokens"]) for r in pieces if r["start"] == 0) == want
    assert sum(r["length"] for r in pieces) == sum(n * k for (_, n), k in want.items())
    load = collections.Counter()
    for r in pieces:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 2048
