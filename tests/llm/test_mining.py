"""Structure repair, hard negatives and the similarity join against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tallywright.llm import common, hard_negatives, jaccard_join, repair
from tallywright.llm.queries import op11_structure_repair, op12_hard_negatives, op13_jaccard_join

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRUCTURE = re.compile(r"(s?(ua)+)?")


# ---- structure repair


def plain_repair(rows):
    """(cost, audit, repaired lines) of [(initial, must go, truncated, role, text)], by costs and strings alone."""
    nxt, step = {"": "u", "s": "u", "u": "a", "a": "u"}, {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(4):
            for q, (c, s, r) in list(best.items()):
                new = (c + 5, s + "I", (*r, ({"u": "user", "a": "assistant"}[nxt[q]] + ":")))
                if nxt[q] not in best or new < best[nxt[q]]:
                    best[nxt[q]] = new
        return best

    for initial, gone, cut, role, text in rows:
        new, before = {}, insert(best)
        for q, (c, s, r) in before.items():
            moves = [(q, c + 2, "D", r)]
            if not gone:
                moves.append((nxt[q], c + 1 + 5 * cut, "R", (*r, {"u": "user", "a": "assistant"}[nxt[q]] + ":" + text)))
                if (q, initial) in step:
                    moves.append((step[q, initial], c + 5 * cut, "K", (*r, f"{role}:{text}")))
            for to, cost, letter, made in moves:
                if to not in new or (cost, s + letter, made) < new[to]:
                    new[to] = (cost, s + letter, made)
        best = new
    return min(v for k, v in insert(best).items() if k in ("", "a"))


def brute_conversations(rows, ids):
    """rows: [(conv_id, turn, role, text)] after damage."""
    out, by = [], defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role if role is not None else " ", text if text is not None else " "))
    for c in {*ids, *by}:
        own, seen, coded, faults = sorted(by[c]), set(), [], [0, 0, 0]
        for _, _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            blank, again = not body, (role, text) in seen
            cut = not blank and not again and body[-1] not in ".!?"
            seen.add((role, text))
            faults = [a + b for a, b in zip(faults, (blank, again and not blank, cut), strict=True)]
            coded.append((role[:1], blank or again, cut, role, text))
        initials = [x[0] for x in coded]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        turns = [t for known, t, _, _ in own if known]
        cost, audit, made = plain_repair(coded)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return out


def conversations():
    rng = random.Random(5)
    texts, roles = ["a.", "b!", "c", "d", "", " \t", "e?", "f. ", "g 　", None], ["user", "assistant", "system", "tool", "", None, "u", "Assistant", "user", "assistant"]
    rows = []
    for c in [*range(120), None]:
        for i in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            rows.append((c, rng.choice([i, i, i, i + 1, 2 * i, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}{rng.choice('.!x')}"))
    rows += [(900, i, ("user", "assistant")[i % 2], f"line {i}" + ("." if i % 7 else "")) for i in range(150)]
    rows += [(901, 3, "user", "same.")] * 60 + [(902, i, "user", "same.") for i in range(40)] + [(903, None, rng.choice(["user", "tool"]), f"x{i}.") for i in range(30)]
    rows += [(904, 1, "user", "long " * 30_000 + "."), (904, 2, "assistant", "x" * 100_000)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, c string, part int, k string, count long, token string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "k", 2, "t") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("long", [2000, 12, 4])
def test_repair(spark, long, monkeypatch):
    monkeypatch.setattr(repair, "LONG", long)
    rows = conversations()
    got = repair.repair_conversations(table(spark, rows), texts=True).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=str) == sorted(brute_conversations(rows, []), key=str)
    for r in got:
        assert hashlib.sha256(r["repaired"].encode()).hexdigest() == r["repaired_sha256"]
        assert r["conv_id"] == 904 or STRUCTURE.fullmatch("".join(x[:1] for x in re.findall(r"^(\w+):", r["repaired"], re.M)))


def test_repair_of_nothing(spark):
    assert repair.repair_conversations(table(spark, [])).collect() == []
    got = repair.repair_conversations(table(spark, []), ids=spark.createDataFrame([(7,), (7,), (None,)], "conv_id long"), texts=False).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (7, None)], key=str)


def test_op11_damages_and_repairs(spark):
    import zlib

    damaged, ids = [], set()
    for c, t, role, text in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        ids.add(c)
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (role if role is not None else " "), (text if text is not None else " ")
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        damaged += [(c, t, "user" if fault == 4 else role, text)] * (0, 2, 1)[(fault == 3) + 2 * (fault not in (0, 3))]
    assert sorted(map(tuple, op11_structure_repair(spark, SF).collect()), key=str) == sorted(brute_conversations(damaged, ids), key=str)


@pytest.mark.parametrize("prime", [2**61 - 1, 7, 2])
def test_audits_with_colliding_hashes(prime):
    audits, rng = repair.Audits(prime), random.Random(prime)
    nodes = [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes[-40:]), rng.choice("DIKR")))
    texts = [audits.text(n) for n in nodes]
    assert len(set(nodes)) == len(set(texts))
    for (a, x), (b, y) in itertools.product(zip(nodes, texts, strict=True), repeat=2):
        assert audits.less(a, b) == (x < y)


# ---- hard negatives


def brute_negatives(rows, every=100, positives=5, negatives=10):
    first = {}
    for i, v, g in rows:
        if i is None or g is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
        first[i] = min(first.get(i, (g, tuple(v), x)), (g, tuple(v), x))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (g, _, x) in first.items():
        if a % every:
            continue
        scored = sorted((-dot(x, y), b, h) for b, (h, _, y) in first.items() if b != a)
        for s, p, _ in [z for z in scored if z[2] == g][:positives]:
            fits = [z for z in scored if z[2] != g and -30 * s <= -100 * z[0] <= -90 * s]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(n, seed, dims=16):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(10, dims))
    label = rng.integers(0, 4, n)
    x = (means[label] * 0.5 + rng.normal(size=(n, dims)) * 0.6).astype(np.float32)
    return [(i, [float(c) for c in v], int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))]


ODD = [
    (None, [1.0, 2.0], 1), (100000, None, 1), (100100, [1.0], None), (100200, [1.0, None], 2), (100300, [float("nan"), 1.0], 2), (100400, [float("inf")], 2), (100500, [], 2), (100600, [0.0] * 16, 1),
    (100700, [1.0] * 3, 1), (100700, [1.0] * 3, 1), (100700, [0.5] * 16, 1), (100700, [0.1] * 16, 3),
]


def embedded(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2.0) for r in rows], "vec_id long, embedding array<float>, label int, id string, i int, v string, score double").repartition(4)


@pytest.mark.parametrize(("block", "chunk"), [(16_384, 2_048), (150, 7)])
def test_hard_negatives(spark, block, chunk, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rows = vectors(1200, 4) + ODD + [(5000 + i, [0.3] * 16, i % 2) for i in range(60)]
    got = sorted(map(tuple, hard_negatives.mine(embedded(spark, rows), every=20).collect()))
    want = brute_negatives(rows, every=20)
    assert got == want and len(want) > 1000
    assert hard_negatives.mine(embedded(spark, [])).collect() == []


def test_hard_negatives_of_very_large_components(spark):
    rows = [(i, [c * 3e6 for c in v], g) for i, v, g in vectors(60, 9, 4)]
    got = sorted((a, p, r, n) for a, p, r, n, _, _ in map(tuple, hard_negatives.mine(embedded(spark, rows), every=20).collect()))
    assert got == [z[:4] for z in brute_negatives(rows, every=20)]


def test_walk_ends_early_and_exactly():
    rng = np.random.default_rng(0)
    x = np.floor(256 * np.concatenate([rng.normal(size=(40, 8)) + 9, rng.normal(size=(20_000, 8))]))
    ids, label = np.arange(len(x)), np.zeros(len(x), int)
    a = x[:4]
    low, high = np.full((4, 1), -np.inf), np.full((4, 1), np.inf)
    i, _, j, s = hard_negatives.walk(a, ids[:4], label[:4], x, ids, label, low, high, 5, True, hard_negatives.fit_centres(a, 2))
    for m in range(4):
        score = x @ a[m]
        score[m] = -np.inf
        assert sorted(s[i == m], reverse=True) == sorted(score, reverse=True)[:5]
    order = np.arange(len(x))
    found = hard_negatives._members(np.arange(4), order[:256], np.r_[np.full(1, 1e12), np.zeros(255)], a, np.ones(4), ids[:4], label[:4], x, ids, label, low, high, 5, True)
    assert len(found[0][0]) == 20


def test_op12(spark):
    rows = [(i, list(v) if v is not None else None, (g + 1) % 10 if g is not None and i % 7 == 0 else g) for i, v, g in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, op12_hard_negatives(spark, SF).collect())) == brute_negatives(rows)


# ---- similarity join


def brute_join(rows, ngram=4, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + ngram]) for i in range(max(1, len(w) - ngram + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in held[g] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return [(d, len(sets[i]), min((x for x in members[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    line = " ".join(rng.choices(words, k=30))
    for base in range(12):
        body = rng.choices(words, k=rng.choice([6, 20, 60, 200]))
        for _ in range(rng.choice([1, 3, 25])):
            own = list(body)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n := n + 1, " ".join(own) + (" " + line if base % 3 == 0 else "")))
    rows += [((n := n + 1), line + " " + " ".join(rng.choices(words, k=3))) for _ in range(40)]  # one common passage
    rows += [(n + 1, line), (n + 2, line.upper()), (n + 3, line), (n + 3, line), (None, line + " z"), (n + 4, ""), (n + 5, None), (n + 6, " \n"), (n + 4, ""), (n + 7, "one"), (n + 8, "ONE"), (n + 9, "one two"), (None, "alone in the world now"), (n + 10, "é x a b c"), (n + 11, "word " * 50_000 + "end")]
    return rows


@pytest.mark.parametrize(("run", "hot", "group", "percent"), [(2_000_000, 64, 1024, 85), (700, 64, 5, 70), (3000, 3, 1024, 85), (100, 2, 8, 50)])
def test_similar_documents(spark, run, hot, group, percent, monkeypatch):
    for name, value in (("RUN", run), ("HOT", hot), ("GROUP", group), ("RUN_TEXTS", max(5, run // 100))):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = texts()
    df = spark.createDataFrame([(*r, "a", "n", "t", "x", "c") for r in rows], "doc_id long, text string, a string, node string, token string, x string, component_id string").repartition(3)
    got = jaccard_join.similar_documents(df, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_join(rows, percent=percent), key=str)
    assert jaccard_join.similar_documents(df.where("false")).collect() == []


def test_op13(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id").collect()), key=str) == sorted(brute_join(rows), key=str)


def test_a_run_sends_its_messages_at_once(spark, monkeypatch):
    class Docs:
        sparkSession = spark
        select = withColumn = lambda self, *_: self
        mapInPandas = lambda self, run, _: run

    monkeypatch.setattr(jaccard_join, "TaskContext", type("T", (), {"get": lambda: type("C", (), {"partitionId": lambda _: 3})()}))
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)).encode() for _ in range(40)]
    pdf = pd.DataFrame({"doc_id": [str(i) for i in range(40)], "t": texts, "text_key": range(40)})
    sent = list(jaccard_join._runs(Docs(), 4, 64, "text", "doc_id")(iter([pdf])))
    assert len(sent) < 10  # a frame for each of the 64 bins took longer than all else, and their number grows with the square of the input
    assert sorted(pd.concat(sent).query("kind == 1").bin) == list(range(64))


def test_words_and_shingles_of_many_texts():
    rng = random.Random(1)
    parts = [b" ", b"\t", b"\x0b", b"\n", b"\x1c", b"\x00", b"a", b"B", "é".encode(), b"xyzxyzxyz", b"q" * 63, b"r" * 64, b"w" * 65, b"l" * 200]
    texts = [b"".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(500)] + [b"", b" ", b"a", b"A b\tc", b"a  b C"]
    h, cuts = common.text_words(texts)
    words = [t.split() for t in texts]
    assert np.diff(cuts).tolist() == list(map(len, words)) and len(h) == cuts[-1]
    key = dict(zip(h.tolist(), [w for t in words for w in t], strict=True))
    assert [key[x] for x in h.tolist()] == [w for t in words for w in t] and len(set(key.values())) == len(key)
    sets = list(common.shingle_sets(texts, 3))
    grams = [{tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set() for w in (t.lower().split() for t in texts)]
    assert [len(s) for s in sets] == [len(g) for g in grams] and all((s[1:] > s[:-1]).all() for s in sets)
    assert sets[-1].tolist() == sets[-2].tolist() and list(common.shingle_sets([], 3)) == []


def test_prefixes_of_alike_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, rng.integers(1, 60), dtype=np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 85 * (len(x) + len(y) - both):
            level = {int(t): int(rng.integers(1, 9)) for t in np.union1d(x, y)}
            for r in range(3):
                p, q = (jaccard_join.ordered(h, np.array([level[int(t)] for t in h]), r, jaccard_join.len_prefix(len(h), 85)) for h in (x, y))
                assert len(np.intersect1d(p, q)) and (jaccard_join.bit_set(p) & jaccard_join.bit_set(q)).any()


# ---- WARC files of other writers


def test_warc_of_version_one_and_of_bytes(spark, tmp_path):
    from tallywright.llm import warc

    bodies = [b"caf\xe9 \xff\xfe", "ünï".encode(), b"a\r\n\r\nWARC/1.0\r\nnot a record"]
    raw = b""
    for i, (body, version) in enumerate(zip(bodies, (b"1.0", b"1.1", b"1.0"), strict=True)):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
        head = f"WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:0000-{i}>\r\nWARC-Target-URI: http://h/{i}\r\nWARC-Date: 2024-01-0{i + 1}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
        raw += b"WARC/" + version + b"\r\n" + head.encode() + block + b"\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(raw)
    got = sorted((r["uri"], bytes(r["body"]), r["status"], r["url"], r["intact"], r["record_id"]) for r in warc.parse_records(warc.read_warc(spark, str(tmp_path))).select("uri", "body", "status", "url", "intact", "record_id").collect())
    assert got == [(f"urn:uuid:0000-{i}", b, 200, f"http://h/{i}", True, None) for i, b in enumerate(bodies)]
