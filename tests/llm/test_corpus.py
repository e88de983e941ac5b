"""The corpus operators against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywright.llm import chat, common, decontaminate, exact_dedup, language, packing, simhash, substring_dedup, token_output, tokens, url_filter, warc
from tallywright.llm.queries import HOST_RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bin string, k string, t string, node string, sha string, window string, pos string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"w{i}" for i in range(60))
ODD = [
    (1, "", "en"), (2, None, "en"), (3, "  \n\t ", None), (4, "one", "en"), (5, "one two", "de"), (6, PASSAGE, "en"), (7, "x " + PASSAGE + " y", "en"),
    (8, PASSAGE, None), (8, PASSAGE, None), (None, "alone here", "fr"), (None, None, None), (9, "...!!! 123", "fr"), (10, "é" * 3000 + " Ünïcode\u2003gap\x1cx", "fr"),
    (11, ("long text " * 20000) + "end", "en"), (12, PASSAGE.upper(), "en"), (13, " ".join(f"w{i}" for i in range(35)), "en"), (14, " ".join(f"w{i}" for i in range(34)), "en"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(d, t, g, "s", 0, "b", "k", "t", "n", "h", "w", "p") for d, t, g in rows], SCHEMA).repartition(3)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def windows_removed(rows, size):
    seen = Counter()
    words = [WORD.findall(t or "") for _, t in rows]
    for w in words:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] += 1
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("v", substring_dedup.COVERS)
def test_covers_are_difference_covers(v):
    assert {(a - b) % v for a in substring_dedup.COVERS[v] for b in substring_dedup.COVERS[v]} == set(range(v))


@pytest.mark.parametrize(("size", "coarse"), [(35, 2048), (20, 2048), (6, 2048), (35, 5)])
def test_substring_dedup(spark, size, coarse, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 500)
    monkeypatch.setattr(substring_dedup, "COARSE", coarse)
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()][:80] + [(d, t) for d, t, _ in ODD]
    got = substring_dedup.dedup_substrings(odd(spark, [(d, t, "en") for d, t in rows]), window=size).collect()
    assert key([tuple(r[:4]) for r in got]) == key(windows_removed(rows, size))
    for r in got:
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        spans = np.frombuffer(r["spans"], np.uint32).reshape(-1, 2).astype(int)
        assert (spans[:, 1] - spans[:, 0]).sum() == r["n_removed"]


def test_substring_dedup_empty(spark):
    assert substring_dedup.dedup_substrings(odd(spark, []), window=35).collect() == []


def brute_print(text, n=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [1, 7, 32])
def test_simhash(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILES", tile)
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()] + [(1000 + d if d else None, t) for d, t, _ in ODD]
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    want = [(rows[i][0], f"{prints[i]:016x}", min((d for d in members[find(i)] if d is not None), default=None), len(members[find(i)])) for i in range(len(rows))]
    got = simhash.near_duplicates(odd(spark, [(d, t, "en") for d, t in rows])).select("doc_id", "fingerprint", "component_id", "group_size").collect()
    assert key([tuple(r) for r in got]) == key(want)
    assert simhash.near_duplicates(odd(spark, [])).collect() == []


def test_compare_equals_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (700, 1), dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, (300, 1), dtype=np.uint64))
    f = np.unique(np.concatenate([base, near]))[:, None]
    i, j = simhash.compare(f, None, 2, 2)
    close = np.bitwise_count(f[:, 0][:, None] ^ f[:, 0][None]) <= 2
    root = np.arange(len(f))
    root[i] = j
    assert len(set(root)) == len(f) - 300 and close[i, j].all()
    a, b = simhash.compare(f[::2], f[1::2], 2, 2)
    assert len(a) <= 300


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_fuse_filter():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        f = exact_dedup.build_filter(keys)
        assert exact_dedup.may_hold(keys, *f).all()
        if n >= 1000:
            assert exact_dedup.may_hold(rng.integers(0, 2**63, 50_000, dtype=np.uint64), *f).mean() < 0.01


def test_exact_dedup(spark, tmp_path, monkeypatch):
    rows = [(d, t) for d, t, _ in ODD] + [(100 + i, "copy") for i in range(50)]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = []
    for d, t in rows:
        g = groups[t or ""]
        top = max((x for x in g if x is not None), default=None)
        want.append((d, top, len(g), d == top, hashlib.sha256((t or "").encode()).hexdigest()))
    table = odd(spark, [(d, t, "en") for d, t in rows])
    assert key([tuple(r) for r in exact_dedup.dedup_table(table).collect()]) == key(want)
    assert exact_dedup.dedup_table(odd(spark, [])).collect() == []
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    exact_dedup.write_snapshot(table.where(half), str(tmp_path / "s"))
    for most in (32_000_000, 0):  # filters that are sent to every task, and filters that meet the batch bucket by bucket
        monkeypatch.setattr(exact_dedup, "FILTER_BYTES", most)
        for batch in (table.where(~half), odd(spark, [])):
            got = exact_dedup.exact_duplicates(table.where(half), batch, str(tmp_path / "s")).collect()
            assert key([tuple(r) for r in got]) == key(want) if batch.count() else len(got) == table.where(half).count()
        groups = exact_dedup._groups(exact_dedup._digests(table, "text", "doc_id"))
        assert exact_dedup.screen(groups, spark.read.parquet(str(tmp_path / "s/filters"))).count() < groups.count()
    assert key([tuple(r) for r in exact_dedup.exact_duplicates(table, odd(spark, [])).collect()]) == key(want)


def plain_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


TRICKY = [
    "It's the dog's; don't 'save it'll", "a=\u0338b c\u0301d e\u0301 , x\u0301, \u0958, \u0958..., …, —, ’s don’t", "<|endoftext|> Foo<|startoftext|>bar <|ENDOFTEXT|>", "é,è! ÇA. \u00a0nb\u2003sp\u3000x",
    "\x00\x01 a\x1cb \x7f \x85 z", "ﬁne İstanbul ΣΑΣ ẞ", "123abc45 a1b2 ½ ²x ٣", "日本語、テスト。 한국어 👩‍👩‍👧 a👍b,", "~~~ --- <|x|> ``q``", "x" * 5000 + " " + "é" * 3000, "", " \n",
]


def encoded(memo, texts):
    out = []
    for first, ids, n in memo.encode(pa.array(texts)):
        assert first == len(out)
        out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return out


def test_word_memo_equals_library(spark, monkeypatch):
    texts = TRICKY + [r["text"] for r in docs(spark).collect()]
    for memo, run in ((300_000, 8_000_000), (50, 1000)):
        monkeypatch.setattr(tokens, "MEMO", memo)
        monkeypatch.setattr(tokens, "RUN", run)
        memo = tokens.WordMemo(tokenizer_path())
        assert memo.by_word
        for text, got, ids in zip(texts, encoded(memo, texts), plain_ids(texts), strict=True):
            assert got == ids, text[:80]
    assert list(memo.encode(pa.array([], pa.string()))) == []


def test_word_memo_over_all_letters():
    letters = [chr(i) for i in range(0x21, 0x3000) if chr(i).isprintable()]
    rng = np.random.default_rng(2)
    texts = [f"{c}. a{c}, ({c}b) {c}'s {c}{c}… “{c}” X{c}Y; 1{c}" for c in letters] + ["".join(rng.choice([*letters[:500], *" .,'“…"], 40)) for _ in range(3000)] + ["İ.", "TARİHİ, GAZETESİ:"]
    for text, got, ids in zip(texts, encoded(tokens.WordMemo(tokenizer_path()), texts), plain_ids(texts), strict=True):
        assert got == ids, text


def test_other_tokenizers_encode_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    memo, texts = tokens.WordMemo(path), ["It's  two\n\n spaces .", "", "<|endoftext|> x"]
    assert not memo.by_word
    assert encoded(memo, texts) == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_rank_code_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rng.integers(0, 2 ** rng.integers(1, 33, n) if n else 1, n).astype(np.uint32)
        assert token_output.decode_ranks(*token_output.encode_ranks(x), n).tolist() == x.tolist()


def test_token_output(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()] + [(10_000 + d if d else d, t) for d, t, _ in ODD] + [(20_000 + i, t) for i, t in enumerate(TRICKY)]
    got = token_output.token_output(odd(spark, [(d, t, "en") for d, t in rows]), tokenizer_path(), with_ids=True).collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    at, want = 0, []
    for (d, _), ids in zip(rows, plain_ids([t or "" for _, t in rows]), strict=True):
        ids = [*ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert token_output.token_output(odd(spark, []), tokenizer_path()).collect() == []


def test_packing(spark):
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()] + [(10_000 + d if d else d, t) for d, t, _ in ODD]
    got = packing.pack_documents(odd(spark, [(d, t, "en") for d, t in rows]), tokenizer_path(), open_windows=4, with_ids=True).collect()
    by_seq, total = defaultdict(list), 0
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert total / (2048 * len(by_seq)) > 0.95
    want = Counter((d, tuple([*ids, 1])) for (d, _), ids in zip(rows, plain_ids([t or "" for _, t in rows]), strict=True))
    docs_got = defaultdict(list)
    for r in got:
        docs_got[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(r["ids"])))
    unique = {k: v for k, v in docs_got.items() if sum(n for (d, x), n in want.items() if d == k[0]) == 1}
    for (d, n), pieces in unique.items():
        ids = tuple(i for _, p in sorted(pieces) for i in p)
        assert want[d, ids] == 1 and n == len(ids)
    assert sum(len(x) * n for (_, x), n in want.items()) == total
    assert packing.pack_documents(odd(spark, []), tokenizer_path()).collect() == []


def test_language(spark):
    table = docs(spark)
    got = language.identify(table, language.fit(table)).join(table.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    model = language.fit(table)
    strange = language.identify(odd(spark), model, keep=("source", "k")).collect()
    assert len(strange) == len(ODD) and Counter(r["lang_pred"] == "und" for r in strange)[True] == 5 and strange[0]["kept"]["k"] == "k"
    empty = odd(spark, [])
    assert language.fit(empty) is None and language.identify(empty, None).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd(spark), None).collect()} == {"und"}


def brute_language(model, text):
    """Language, score and gap by plain Python."""
    chars = [ord(c) if c.isalpha() else 32 for c in text.lower()]
    chars = [c for i, c in enumerate(chars) if c != 32 or i == 0 or chars[i - 1] != 32]
    counts = Counter()
    for n in range(3):
        for i in range(len(chars) - n):
            h = 0
            for c in chars[i : i + n + 1]:
                h = (h * 0x110001 + c + 1) % 2**64
            h = (h + (n << 56)) % 2**64
            for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
                h = (h ^ h >> shift) * by % 2**64
            counts[h % language.FEATURES] += 1
    total = sum(counts.values())
    z = [sum(math.sqrt(k / total) * float(model.weights[f, b]) for f, k in counts.items()) + float(model.bias[b]) for b in range(model.codes.shape[1])]
    loss = [sum(math.log1p(math.exp(-abs(x * c))) + max(0.0, -x * c) for x, c in zip(z, code, strict=True)) / len(z) for code in model.codes.tolist()]
    odds = [math.exp(-(x - min(loss)) * len(z)) for x in loss]
    return model.langs[loss.index(min(loss))], 1 / sum(odds), sorted(loss)[1] - min(loss)


def test_language_equals_brute_force(spark):
    table = docs(spark).select("doc_id", "text", "lang").union(odd(spark).where("text is not null").select(F.col("doc_id") + 10_000, "text", "lang"))
    model = language.fit(table)
    got = language.identify(table, model, keep=("text",)).collect()
    for r in got:
        if not any(map(str.isalpha, r["kept"]["text"])):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, False)
            continue
        lang, score, gap = brute_language(model, r["kept"]["text"])
        assert abs(r["score"] - score) < 1e-4
        if gap > 1e-4:
            assert r["lang_pred"] == lang
        if abs(gap - language.CLOSE) > 1e-4:
            assert r["ambiguous"] == (gap < language.CLOSE)


def test_language_learns_every_language(spark):
    rng = np.random.default_rng(8)
    alphabets = [[chr(0x4E00 + 20 * k + i) for i in range(20)] for k in range(230)]
    rows = [(i, "".join(rng.choice(alphabets[i % 230], 30)), f"l{i % 230}") for i in range(230 * 4)]
    table = odd(spark, rows)
    model = language.fit(table, per_language=2, most=300)
    assert len(model.langs) == len({g for d, _, g in rows if zlib.crc32(str(d).encode()) % 4 != 2}) > 220
    got = language.identify(table, model, keep=("lang",)).collect()
    assert sum(r["lang_pred"] == r["kept"]["lang"] for r in got) > 0.5 * len(got)


def test_codewords():
    for k in (2, 3, 4, 5, 20):
        c = language.codewords(k)
        assert len({tuple(r) for r in c}) == k


def test_words_of():
    for t in ["Ab_c 12d,é-É", "x\u00a0y “z” …", "e\u0301a İ", "", "a\x1cb\x00c"]:
        assert decontaminate.words_of(t).tolist() == [xxhash.xxh64_intdigest(w.encode()) for w in re.findall(r"[^\W_]+", t.lower())]


def brute_matches(rows, bench, least=0.8):
    norm = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(max(0, len(w) - n + 1)))
    out = []
    for d, t in rows:
        w = norm(t)
        for i, b in bench:
            x = norm(b)
            if not w or not x:
                continue
            n = min(5, len(x), len(w)) if len(w) < min(5, len(x)) else min(5, len(x))
            g, best = grams(x, n if len(x) >= n else len(x)), 0.0
            if len(w) < min(5, len(x)):
                continue  # too short to hold a shingle of the item
            for s in range(max(1, len(w) - len(x) + 1)):
                own = grams(w[s : s + len(x)], n)
                both = sum((own & g).values())
                best = max(best, both / (sum(own.values()) + sum(g.values()) - both) if own else 0)
            if best >= least:
                out.append((d, i, round(best, 9)))
    return out


def test_decontaminate(spark):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    extra = [(900, "four words only here"), (901, None), (902, ""), (903, "?!")]
    words = bench[0][1].split()
    near = [*words[:-1], "changed"]
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect()] + [(10_000 + d if d else d, t) for d, t, _ in ODD if d != 11]
    rows += [(5000, "x y z " + " ".join(near) + " tail words"), (5001, bench[1][1].upper().replace(" ", "  ")), (5002, "say four words only here now"), (5003, " ".join(words[3:])), (5004, " ".join(words) + " and " + " ".join(words))]
    table = odd(spark, [(d, t, "en") for d, t in rows])
    got = decontaminate.contaminated(table, spark.createDataFrame(bench + extra, "item_id long, text string")).collect()
    assert key([(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in got]) == key(brute_matches(rows, bench + extra))
    assert {5000, 5001, 5002, 5004} <= {r["doc_id"] for r in got}
    assert decontaminate.contaminated(table, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert decontaminate.contaminated(odd(spark, []), spark.createDataFrame(bench, "item_id long, text string")).collect() == []


@pytest.mark.parametrize(("radius", "blocks"), [(17, 9), (19, 4), (3, 4), (0, 1)])
def test_multi_index_finds_all_within_the_radius(radius, blocks):
    rng = np.random.default_rng(1)
    if blocks == 1:
        blocks = 8
    index = decontaminate.Index([(str(i), f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(40)], 5, radius, blocks)
    f = np.concatenate([index.prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in range(0, 24)])
    want = {(int(r), int(c)) for r, c in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ index.prints[None]) <= radius), strict=True)}
    assert set(index.near(6, f)) == want and len(index.near(6, f)) == len(want)


def test_decontaminate_recall():
    rng, found, alike = np.random.default_rng(4), 0, 0
    for size in (8, 12, 20, 40, 80, 150):
        for trial in range(60):
            item = [f"w{x}" for x in rng.integers(0, 10**9, size)]
            index = decontaminate.Index([("1", " ".join(item))], 5, decontaminate.RADIUS, decontaminate.BLOCKS)
            copy = list(item)
            for k in rng.choice(size, 1 + trial % 3, replace=False) if size > 20 else [[0, size - 1][trial % 2]]:
                copy[k] = f"new{rng.integers(0, 10**9)}"
            grams = lambda w: Counter(zip(*[w[i:] for i in range(5)], strict=False))
            both = sum((grams(item) & grams(copy)).values())
            if both >= 0.8 * (2 * (size - 4) - both) - 1e-9:
                alike += 1
                found += bool(index.matches(decontaminate.words_of(" ".join(copy)), 0.8 - 1e-9))
    assert alike > 100 and found >= 0.97 * alike


def test_decontaminate_reads_long_texts_whole(spark):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "one two three four five six seven eight")], "item_id long, text string")
    got = decontaminate.contaminated(odd(spark, [(1, "filler " * 150_000 + PASSAGE, "en"), (2, "filler " * 150_000, "en")]), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["similarity"]) for r in got] == [(1, 1, 150_000, 1.0)]


def test_decontaminate_parts(spark, monkeypatch):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    one = decontaminate.contaminated(docs(spark), spark.createDataFrame(bench, "item_id long, text string")).collect()
    monkeypatch.setattr(decontaminate, "PART", 7)
    assert key(one) == key(decontaminate.contaminated(docs(spark), spark.createDataFrame(bench, "item_id long, text string")).collect())


CHAT = "conv_id long, turn long, role string, text string, block string, pos string, a string, n string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CHAT)


@pytest.mark.parametrize("block", [1000, 2])
def test_chat(spark, block, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 5, "user", "hi"), (3, 9, "assistant", "yo"), (3, 11, "user", "more"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"), (None, 0, "user", None), (None, None, None, ""), (6, 0, "user", "hi"), (6, 0, "user", "hi"),
        *[(7, t, "user", f"t{t}") for t in (999, 1000, -1, -2000, 5000)], (7, None, "user", "first"), (8, None, "user", "first"), (8, -7, "user", "t-2000"), *[(9, t, "user", "long " * 50_000) for t in range(3)],
    ]
    got = chat.format_chats(chats(spark, rows)).collect()
    turn = lambda r, t: f"<|{r}|>\n{t}<|end|>\n"
    texts = {(r["conv_id"], r["n_turns"]): r["text"] for r in got}
    assert len(texts) == len(got)
    want = {(3, 3): turn("user", "hi") + turn("assistant", "yo") + turn("user", "more"), (4, 2): turn("user", "hi") + turn("assistant", "no"), (6, 2): turn("user", "hi") * 2, (None, 2): turn("", "") + turn("user", "")}
    want |= {(7, 6): "".join(turn("user", x) for x in ("first", "t-2000", "t-1", "t999", "t1000", "t5000")), (9, 3): turn("user", "long " * 50_000) * 3}
    assert texts == want
    assert chat.format_chats(chats(spark, [])).collect() == []


def test_url_filter(spark):
    urls = [
        "https://EXAMPLE.net/en/a?x#y", "http://a.b.example.net/de/", "http://example.com/de/x", "http://www.example.org/fr/", "http://badexample.net/en/", "https://x.net", "no scheme", None, "http://x.com/login",
        "http://x.com/loginpage", "ftp://net/", "http://adserver.x.com", "a://b://net/x", "http://shop.com/checkout?x", "",
    ]
    want = [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("login pages", "block"),
            (None, "allow"), ("net/", "block"), ("advertising servers", "block"), (None, "allow"), ("shopping carts", "block"), (None, "allow")]
    table = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = url_filter.filter_urls(table, HOST_RULES + url_filter.OWN_PATTERNS).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == want
    assert (got[0]["host"], got[0]["path"], got[12]["host"], got[12]["path"]) == ("example.net", "/en/a", "b:", "//net/x")
    part = url_filter.filter_urls(table, (url_filter.host_rule("block", "x.com", "/log"),)).where("verdict = 'block'").collect()
    assert sorted(r["page_id"] for r in part) == [8, 9]
    assert url_filter.filter_urls(table.limit(0), HOST_RULES).collect() == []


def test_url_filter_with_thousands_of_rules(spark, monkeypatch):
    rng = np.random.default_rng(6)
    name = lambda: f"{rng.choice(['shop', 'news', 'blog', 'x'])}{rng.integers(0, 400)}.{rng.choice(['com', 'net', 'org'])}"
    folder = lambda: f"/{rng.choice(['a', 'img', 'Tag'])}{rng.integers(0, 9)}"
    hosts = list({(h, p): (str(rng.choice(["allow", "block"])), h, p) for h, p in ((name(), folder() if rng.random() < 0.5 else "/") for _ in range(3000))}.values())
    patterns = [("block", f"tracker {i}", rf"(?i)/track{i}(?:/|\Z)", [f"track{i}"]) for i in range(500)] + [("block", "empty", r"\A\Z", [])]
    urls = [f"http://{'www.' * int(rng.integers(0, 2))}{name()}{folder()}{folder()}" for _ in range(1500)] + [f"https://{name()}/TRACK{i}" for i in range(0, 700, 7)] + [None, "nothing", "http://" + name() + "/a1" * 20_000]
    urls += urls[:5]
    want = []
    for u in urls:
        rest = (u or "").partition("://")[2]
        h, p = re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        own = [(-1_000_000 - len(x + q), x + q, v) for v, x, q in hosts if (h == x or h.endswith("." + x)) and p.startswith(q)]
        own += [(-len(e), n, v) for v, n, e, _ in patterns if re.search(e, h + p)]
        want.append(min(own)[1:] if own else (None, "allow"))
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([(v, h, p, None, None, None) for v, h, p in hosts] + [(v, None, None, n, e, t) for v, n, e, t in patterns] + [("block", None, None, "none", None, None)], "verdict string, host string, path string, name string, pattern string, tokens array<string>")
    for most in (200_000, 1000):
        monkeypatch.setattr(url_filter, "RULES", most)
        got = url_filter.filter_urls(table, rules).orderBy("page_id").collect()
        assert [(r["rule"], r["verdict"]) for r in got] == want
    assert {r["verdict"] for r in url_filter.filter_urls(table, ()).collect()} == {"allow"}


def test_warc(spark, tmp_path, monkeypatch):
    rows = [
        (1, "HTTP://Site.com:80/a?utm_source=x&q=1#f", "response", "2024-01-01 00:00:00", 200, 'ETag: W/"1"\r\nX-Keep: y\r\nCache-Control: old\r\n', "body one"),
        (2, "http://site.com/a?q=1", "revisit", "2024-01-03 00:00:00", 304, 'etag: "1"\r\nCache-Control: new\r\nServer: s\r\n', ""),
        (3, "http://site.com/a?q=1", "revisit", "2024-01-01 00:00:00", 304, 'ETag: "1"\r\n', ""),
        (4, "http://site.com/a?q=1", "response", "2024-01-02 00:00:00", 404, 'ETag: "9"\r\n', "gone"),
        (5, "http://site.com/a?q=1", "revisit", "2024-01-04 00:00:00", 304, 'ETag: "2"\r\n', ""),
        (6, "http://site.com/a?q=1", "revisit", "2024-01-04 00:00:01", 304, "", ""),
        (7, "http://b.com", "response", "2024-01-01 10:00:00", 200, "Last-Modified: m\r\n", "é\n\nb"),
        (8, "http://b.com/", "revisit", "2024-01-01 11:00:00", 304, "Last-Modified: m\r\n", None),
        (9, None, "revisit", None, 304, None, None),
        (10, "http://c.com/", "response", "2024-01-01 10:00:00", 200, "ETag: x\r\n", "about WARC\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nend " + "long " * 100_000),
        (11, "http://c.com/", "revisit", "2024-01-01 10:00:01", 304, "ETag: x\r\n", ""), (11, "http://c.com/", "revisit", "2024-01-01 10:00:01", 304, "ETag: x\r\n", ""),
    ]
    table = spark.createDataFrame(rows, "record_id long, url string, kind string, at string, status int, http string, payload string").withColumn("at", F.to_timestamp("at"))
    for name in ("u", "t", "block", "own", "b2", "resp"):
        table = table.withColumn(name, F.lit("clash"))
    monkeypatch.setattr(warc, "BLOCK", 86_400)
    for block in (86_400, 7200):
        monkeypatch.setattr(warc, "BLOCK", block)
        got = {r["record_id"]: r for r in warc.resolve_revisits(table).collect()}
        assert {k: (r["outcome"], r["response_id"]) for k, r in got.items()} == {2: ("resolved", 1), 3: ("no_response", None), 5: ("mismatch", None), 6: ("unverified", None), 8: ("resolved", 7), 9: ("no_response", None), 11: ("resolved", 10)}
        assert got[11]["digest"] == hashlib.sha256(rows[9][6].encode()).hexdigest()
        assert got[2]["headers"] == 'cache-control: new\netag: "1"\nx-keep: y' and got[8]["digest"] == hashlib.sha256("é\n\nb".encode()).hexdigest()
        assert got[2]["canonical_url"] == "http://site.com/a?q=1" and got[8]["canonical_url"] == "http://b.com/"
    warc.write_warc(table, str(tmp_path / "w"))
    back = warc.parse_records(warc.read_warc(spark, str(tmp_path / "w")))
    assert back.where("intact").count() == len(rows)
    assert sorted(map(tuple, warc.resolve_revisits(back).collect())) == sorted(map(tuple, warc.resolve_revisits(table).collect()))
    assert warc.resolve_revisits(table.limit(0)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as p

    table = odd(spark, [*[(r["doc_id"], r["text"], r["lang"]) for r in docs(spark).collect()], *[(10_000 + d if d else d, t, g) for d, t, g in ODD]])
    kept = p.keep_language(spark, table, SF)
    assert kept.columns == table.columns and {r["text"] for r in table.exceptAll(kept).collect()} == {t for _, t, _ in ODD if not any(map(str.isalpha, t or ""))}
    once = p.drop_exact_copies(spark, kept, SF).collect()
    assert len({r["text"] for r in once}) == len(once) == len({r["text"] for r in kept.collect()})
    top = defaultdict(lambda: -1)
    for r in kept.collect():
        top[r["text"]] = max(top[r["text"]], -1 if r["doc_id"] is None else r["doc_id"])
    assert all((-1 if r["doc_id"] is None else r["doc_id"]) == top[r["text"]] for r in once)
    near = p.drop_near_copies(spark, spark.createDataFrame(once, table.schema), SF)
    left = {r["doc_id"] for r in near.collect()}
    grams = lambda t: {tuple(w) for w in zip(*[t.lower().split()[i:] for i in range(5)], strict=False)}
    sets = {r["doc_id"]: grams(r["text"]) for r in once}
    ids = sorted((d for d in sets if d is not None and len(sets[d]) > 20))
    alike = {d: max((len(sets[d] & sets[e]) / len(sets[d] | sets[e]) for e in ids if e != d), default=0) for d in ids}
    assert all(d in left for d in ids if alike[d] < 0.5)
    sure = [d for d in ids if alike[d] > 0.9]
    assert not sure or any(d not in left for d in sure)
    clean = p.drop_contaminated(spark, near, SF)
    assert clean.columns == table.columns
    pieces = p.pack(spark, clean, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in clean.collect()}


def test_near_stage_equals_brute_force(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(11)
    text = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).collect() if (r["text"] or "").strip()]
    for n in (10, 11, 12, 40, 100, 300):
        for g in range(12):
            base, at = text(n), 10_000 + 1000 * n + 10 * g
            rows.append((at, " ".join(base)))
            for i, changed in enumerate((1, 2, 3, 5), 1):  # similarities about 0.8
                copy = list(base)
                for w in rng.integers(0, n, max(1, n * changed // 100)):
                    copy[w] = f"new{rng.integers(0, 10**9)}"
                rows.append((at + i, " ".join(copy[: n - i % 2])))
    rows += [(1, "Two Words"), (2, "two  words"), (None, "two\twords"), (None, "TWO WORDS"), (3, "one two three four five six seven eight nine"), (4, "one two three four five six seven eight")]
    rows = list({t: (d, t) for d, t in rows}.values())
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, x in enumerate(sets):
        for y in x:
            holders[y].append(i)
    for i, j in {(i, j) for h in holders.values() for i in h for j in h if i < j}:
        both = len(sets[i] & sets[j])
        if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    want = sorted(min((d for d in g if d is not None), default=-1) for g in groups.values())
    table = odd(spark, [(d, t, "en") for d, t in rows])
    for chunk in (256, 2):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(simhash, "CHUNK", chunk, raising=False)
            got = p.drop_near_copies(spark, table, SF)
            assert got.columns == table.columns
            assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in got.collect()) == want
    assert p.drop_near_copies(spark, odd(spark, []), SF).collect() == []


def test_near_stage_finds_pairs_that_fingerprints_miss(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    first = lambda words: simhash.majority(np.unique(simhash.shingle_hashes(" ".join(words).encode(), 5)))
    for _ in range(100_000):  # 4 of 5 shingles in common, and the fingerprints' first 64 bits far apart
        long = [f"t{x}" for x in rng.integers(0, 10**6, 9)]
        if (first(long) ^ first(long[:8])).bit_count() > 22:
            break
    rows = [(1, " ".join(long), "en"), (2, " ".join(long[:8]), "en"), (3, "one two three four five six", "en")]
    assert sorted(r["doc_id"] for r in p.drop_near_copies(spark, odd(spark, rows), SF).collect()) == [1, 3]


def test_near_stage_does_not_compare_all_with_all(spark):
    import corpus_pipeline as p

    n = 4000
    docs = spark.range(n).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 30), x -> hex(xxhash64(id, x))), ' ') AS text", "'en' AS lang")
    before = shuffled_rows(spark)
    assert p.drop_near_copies(spark, docs, SF).count() == n
    assert shuffled_rows(spark) - before < 6 * n


def shuffled_rows(spark):
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_language_stage_without_labels(spark):
    import corpus_pipeline as p

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for rows in ([(d, t, None) for d, t, _ in ODD], [(held, t, "en") for _, t, _ in ODD]):
        table = odd(spark, rows)
        got = p.keep_language(spark, table, SF)
        assert got.columns == table.columns
        assert key(map(tuple, got.select("doc_id", "text").collect())) == key([(d, t) for d, t, _ in rows if any(map(str.isalpha, t or ""))])


def test_features_fold_every_code_point():
    plain = language.features("one two three")
    for text in ("one 12, two\n\n  three", "one \U0001f600 two, 3 three", "one、two 1!。  three", "one \ud800 two three"):
        assert (language.features(text) == plain).all()
    assert (language.features("日本語、 テスト 12") == language.features("日本語 テスト ")).all()
    assert (language.features("\U00020000a") != language.features("a")).any() and not language.features("").any()
