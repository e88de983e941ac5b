"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then pairs of user
and assistant turns, with an audit string of the edits, by dynamic programming over the rows.

Audits are persistent: each is a node linked to its prefix, so states share prefixes. A node has its depth, a rolling hash and
binary-lifting ancestors. Audits of equal cost are compared by a search for their longest common prefix over the ancestors'
hashes. A node is looked up by its hash and verified by its prefix and letter when it is made, so equal strings are one node, and two
strings whose hashes collide get different ones.

Conversations of up to LONG rows are repaired each in one pass. A longer one is dealt into blocks of rows in order; a block
gives the best audit from each state to each, and the blocks' tables are multiplied (costs add up, audits are joined).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import hub_join
from .common import shuffle_width, small_batches, written

#: Rows of a conversation beyond which it is dealt into blocks, and of a block, about.
LONG = 2_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. What a u or a leads to, from each.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
#: What a kept row of initial s, u, a or another leads to, from each state (None: nowhere).
_STEP = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
_INITIALS, _FINE, _TRUNCATED, _GONE = "sua", 0, 1, 2
_BASE, _PRIME = 1_000_003, 2**61 - 1


class Audits:
    """Strings of edits as linked nodes; 0 is the empty one."""

    def __init__(self, prime: int = _PRIME):
        self.prime = prime
        self.letter, self.depth, self.hash, self.up, self.known = [""], [0], [0], [[0]], {0: 0}

    def add(self, node: int, letter: str) -> int:
        """The node of the string of `node` and the letter."""
        h = (self.hash[node] * _BASE + ord(letter)) % self.prime
        while (found := self.known.get(h)) is not None:
            if found and self.up[found][0] == node and self.letter[found] == letter:
                return found
            h = h + 1  # another string's hash
        new = self.known[h] = len(self.letter)
        up, k = [node], 0
        while k < len(self.up[up[k]]) and up[k]:
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(h)
        self.up.append(up)
        return new

    def _at(self, node: int, depth: int) -> int:
        gap, k = self.depth[node] - depth, 0
        while gap:
            if gap & 1:
                node = self.up[node][k]
            gap, k = gap >> 1, k + 1
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether a's string comes before b's."""
        m = min(self.depth[a], self.depth[b])
        x, y = self._at(a, m), self._at(b, m)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b]
        for k in range(m.bit_length() - 1, -1, -1):
            if k < len(self.up[x]) and k < len(self.up[y]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def _settle(best: dict, audits: Audits, state: int, cost: int, node: int, letter: str) -> bool:
    """Enters node + letter for the state if it is cheaper than what is there, or as cheap and earlier."""
    old = best.get(state)
    if old is not None and cost > old[0]:
        return False
    new = audits.add(node, letter)
    if old is None or cost < old[0] or new != old[1] and audits.less(new, old[1]):
        best[state] = (cost, new)
        return True
    return False


def _inserted(best: dict, audits: Audits) -> dict:
    again = True
    while again:
        again = False
        for state, (cost, node) in sorted(best.items(), key=lambda x: x[1][0]):
            again |= _settle(best, audits, _NEXT[state], cost + INSERT, node, "I")
    return best


def edits(codes: bytes, start: int, audits: Audits) -> dict[int, tuple[int, int]]:
    """state: (cost, audit) after the rows, from the state `start`. A row's code is 4 * kind + its role's initial."""
    best = _inserted({start: (0, 0)}, audits)
    for code in codes:
        kind, initial = divmod(code, 4)
        new: dict = {}
        for state, (cost, node) in best.items():
            _settle(new, audits, state, cost + DELETE, node, "D")
            if kind != _GONE:
                more, kept = TRUNCATED if kind == _TRUNCATED else 0, _STEP[state][initial]
                if kept is not None:
                    _settle(new, audits, kept, cost + KEEP + more, node, "K")
                if kept != _NEXT[state]:
                    _settle(new, audits, _NEXT[state], cost + REROLE + more, node, "R")
        best = _inserted(new, audits)
    return best


@lru_cache(100_000)
def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation. Conversations of equal codes share it."""
    audits = Audits()
    best = edits(codes, START, audits)
    return min([(best[s][0], audits.text(best[s][1])) for s in (START, ASSISTANT) if s in best])


def row_codes(roles: list[str], texts: list[str], seen: list[bool]) -> bytes:
    """A code for each row; seen: whether its role and text were there before."""
    out = bytearray()
    for role, text, again in zip(roles, texts, seen, strict=True):
        body = text.rstrip(SPACE)
        kind = _GONE if not body or again else _FINE if body[-1] in ".!?" else _TRUNCATED
        out.append(4 * kind + (_INITIALS.find(role[0]) if role and role[0] in _INITIALS else 3))
    return bytes(out)


def lines(audit: str, codes: bytes, roles: list[str], texts: list[str], state: int = START) -> Iterator[str]:
    """The repaired rows as role:text."""
    i = 0
    for letter in audit:
        if letter != "D":
            kept = _STEP[state][codes[i] % 4] if letter == "K" else _NEXT[state]
            role = roles[i] if letter == "K" else "user" if kept == USER else "assistant"
            yield f"{role}:{texts[i] if letter != 'I' else ''}"
            state = kept
        i += letter != "I"


def _illegal(initials: np.ndarray) -> int:
    """Neighbours whose initials are not su, ua or au."""
    a, b = initials[:-1], initials[1:]
    return int((~((b == 1) & (a == 0) | (a == 1) & (b == 2) | (a == 2) & (b == 1))).sum())


def _faults(roles: list[str], texts: list[str], seen: list[bool]) -> tuple[int, int, int]:
    blank = [not t.strip(SPACE) for t in texts]
    again = [s and not b for s, b in zip(seen, blank, strict=True)]
    return sum(blank), sum(again), sum(not b and not s and t.rstrip(SPACE)[-1] not in ".!?" for t, b, s in zip(texts, blank, seen, strict=True))


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def _text(values: list) -> pd.Series:
    """A column of Python strings (pandas' own string columns can't leave a grouped function)."""
    return pd.Series(values, dtype=object)


def _short(rows: DataFrame, texts_too: bool) -> DataFrame:
    """Repairs conversations that each fit in one pass: rows are sorted within tasks and come in order."""

    def one(c: str, parts: list[pd.DataFrame]) -> tuple:
        pdf = pd.concat(parts)
        roles, texts = pdf.role.tolist(), pdf.text.tolist()
        known: set = set()
        seen = [(p in known) or known.add(p) is not None for p in zip(roles, texts, strict=True)]
        codes = row_codes(roles, texts, seen)
        cost, audit = cheapest(codes)
        body = "\n".join(lines(audit, codes, roles, texts))
        return (c, _gaps([int(t) for t in pdf.turn.tolist() if t is not None]), *_faults(roles, texts, seen), _illegal(np.frombuffer(codes, np.uint8) % 4), cost, audit, hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), body if texts_too else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for pdf in batches:
            out, c = [], pdf.c.to_numpy(object)
            pdf = pdf.assign(turn=pdf.turn.astype(object).where(pdf.known, None))
            cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a and held and c[a] != last:
                    out.append(one(last, held))
                    held = []
                if b > a:
                    held.append(pdf.iloc[a:b])
                    last = c[a]
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([one(last, held)], columns=names)

    names = ["c", *FACTS, "audit", "repaired_sha256", "repaired"]
    turn = F.coalesce("turn", F.lit(0)).alias("turn")
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "c").sortWithinPartitions("c", F.asc_nulls_first("turn"), "role", "text")
    return dealt.select("c", turn, F.col("turn").isNotNull().alias("known"), "role", "text").mapInPandas(run, "c string, " + ", ".join(f"{f} long" for f in FACTS) + ", audit string, repaired_sha256 string, repaired string")


def _product(a: list, b: list) -> list:
    """Best (cost, audit) from each state to each by way of a, then b."""
    return [[min([(x[0] + y[0], x[1] + y[1]) for m in range(4) if (x := a[s][m]) is not None and (y := b[m][e]) is not None], default=None) for e in range(4)] for s in range(4)]


def _long(rows: DataFrame, texts_too: bool) -> DataFrame:
    """Repairs conversations of many rows, in blocks. Equal rows are counted first, and a text's first row is found by a
    partial minimum, so that no key's rows meet in one task. The hash of the repaired text is one pass over it, in order and in
    bounded memory; an audit is one value of a byte for each edit."""
    spark = rows.sparkSession
    text_key = F.md5(F.concat(F.length("c").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "c", "role", "text"))
    equal = rows.groupBy("c", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("k", text_key)
    equal = written(equal)
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = equal.groupBy("k").agg(F.min(at).alias("first"))
    marked = hub_join(equal, first, "k").withColumn("again", ~(F.col("turn").eqNullSafe(F.col("first.turn")))).drop("k", "first")
    blocks = max(1, -(-marked.count() // LONG))
    order = ("c", F.asc_nulls_first("turn"), "role", "text")
    dealt = marked.repartitionByRange(blocks, *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt)

    def spread(pdf: pd.DataFrame) -> tuple:
        known = pdf.turn.notna().to_numpy()
        pdf = pdf.assign(rank=np.where(known, 1, 0), turn=[int(t) if k else 0 for t, k in zip(pdf.turn, known, strict=True)]).sort_values(["rank", "turn", "role", "text"], kind="stable")
        n = pdf.copies.to_numpy()
        first = np.repeat(np.r_[0, np.cumsum(n)[:-1]], n) == np.arange(n.sum())
        role, text, again = (np.repeat(pdf[c].to_numpy(object), n).tolist() for c in ("role", "text", "again"))
        seen = [bool(a) or not f for a, f in zip(again, first, strict=True)]
        return [t for t, r in zip(pdf.turn, pdf["rank"], strict=True) if r], role, text, seen

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        turns, roles, texts, seen = spread(pdf)
        codes = row_codes(roles, texts, seen)
        table = []
        for start in range(4):
            audits = Audits()
            best = edits(codes, start, audits)
            table += [(best[e][0], audits.text(best[e][1])) if e in best else (-1, "") for e in range(4)]
        blank, again, cut = _faults(roles, texts, seen)
        own = np.frombuffer(codes, np.uint8) % 4
        return pd.DataFrame({"c": _text([key[0]]), "part": [key[1]], "rows": [len(codes)], "codes": [codes], "costs": [[int(t[0]) for t in table]], "audits": [[t[1] for t in table]], "blank": [blank], "duplicate": [again], "truncated": [cut], "illegal": [_illegal(own)], "turns": [len(set(turns))], "low": pd.array([min(turns) if turns else None], "Int64"), "high": pd.array([max(turns) if turns else None], "Int64")})

    schema = "c string, part int, rows long, codes binary, costs array<long>, audits array<string>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"
    tables = written(dealt.groupBy("c", "part").applyInPandas(block, schema))

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part").reset_index(drop=True)
        left = [[[None if x[4 * s + e][0] < 0 else x[4 * s + e] for e in range(4)] for s in range(4)] for x in ([(int(z), y) for z, y in zip(c, a, strict=True)] for c, a in zip(pdf.costs, pdf.audits, strict=True))]
        while len(left) > 1:
            left = [_product(left[i], left[i + 1]) if i + 1 < len(left) else left[i] for i in range(0, len(left), 2)]
        cost, audit = min([x for x in (left[0][START][START], left[0][START][ASSISTANT]) if x is not None])
        codes, letters = b"".join(pdf.codes), np.frombuffer(audit.encode(), np.uint8)
        rows_before, out_before = np.cumsum(letters != ord("I")), np.cumsum(letters != ord("D"))
        begins = np.searchsorted(rows_before, np.r_[0, np.cumsum(pdf.rows)], side="right")  # inserts between two blocks go to the first
        begins[0], begins[-1] = 0, len(letters)
        firsts = np.flatnonzero(letters != ord("D"))[:1]
        system = len(firsts) > 0 and letters[firsts[0]] == ord("K") and codes[rows_before[firsts[0]] - 1] % 4 == 0
        states = [START if not o else (SYSTEM if o == 1 else (ASSISTANT, USER)[o % 2 == 0]) if system else (ASSISTANT, USER)[o % 2] for o in (int(out_before[b - 1]) if b else 0 for b in begins[:-1])]
        lows, highs = [int(x) for x in pdf.low.dropna()], [int(x) for x in pdf.high.dropna()]
        shared = sum(a == b for a, b in zip(highs[:-1], lows[1:], strict=True))  # a turn that two blocks hold
        ends = [(c[-1] % 4, d[0] % 4) for c, d in zip(pdf.codes[:-1], pdf.codes[1:], strict=True)]
        out = pd.DataFrame({"part": pdf.part.to_numpy(), "state": states})
        out["c"], out["slice"] = _text([key[0]] * len(out)), _text([audit[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)])
        gaps = highs[-1] - lows[0] + 1 - (int(pdf.turns.sum()) - shared) if lows else 0
        facts = (gaps, int(pdf.blank.sum()), int(pdf.duplicate.sum()), int(pdf.truncated.sum()), int(pdf.illegal.sum()) + sum(_illegal(np.array(e)) for e in ends), cost)
        head = out.part == out.part.min()
        for name, value in zip((*FACTS, "audit"), (*facts, audit), strict=True):
            out[name] = pd.Series(np.where(head, value, None), index=out.index, dtype="Int64" if name != "audit" else object)
        return out

    joined = written(tables.groupBy("c").applyInPandas(join, "c string, part int, state int, slice string, " + ", ".join(f"{f} long" for f in FACTS) + ", audit string"))

    def render(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        _, roles, texts, seen = spread(own)
        made = list(lines(found.slice.iloc[0], row_codes(roles, texts, seen), roles, texts, int(found.state.iloc[0])))
        return pd.DataFrame({"c": _text([key[0]][: len(made)]), "part": [key[1]][: len(made)], "piece": _text(["\n".join(made)][: len(made)])})

    pieces = dealt.groupBy("c", "part").cogroup(joined.select("c", "part", "state", "slice").groupBy("c", "part")).applyInPandas(render, "c string, part int, piece string")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, sha, body = None, None, []
        for pdf in batches:
            out = []
            for c, piece in zip(pdf.c, pdf.piece, strict=True):
                if c != last:
                    if last is not None:
                        out.append((last, sha.hexdigest(), "\n".join(body) if texts_too else None))
                    last, sha, body = c, hashlib.sha256(), []
                else:
                    sha.update(b"\n")
                sha.update(piece.encode("utf-8", "surrogatepass"))
                if texts_too:
                    body.append(piece)
            if out:
                yield pd.DataFrame(out, columns=["c", "repaired_sha256", "repaired"])
        if last is not None:
            yield pd.DataFrame([(last, sha.hexdigest(), "\n".join(body) if texts_too else None)], columns=["c", "repaired_sha256", "repaired"])

    hashed = pieces.repartition(shuffle_width(spark), "c").sortWithinPartitions("c", "part").mapInPandas(digest, "c string, repaired_sha256 string, repaired string")
    facts = joined.where("audit IS NOT NULL").select("c", *FACTS, "audit").join(hashed, "c", "left")
    return facts.select("c", *FACTS, "audit", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"), F.coalesce("repaired", F.lit("") if texts_too else F.lit(None)).alias("repaired"))


def _conversation() -> Column:
    return F.to_json(F.struct("conv_id"))


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """Repairs (conv_id, turn, role, text): one row for each conv_id of the rows and of `ids` (conv_id).

    A conversation's rows are taken by turn (nulls first), then role and text. Each row's first fault counts: blank (no character but
    ASCII white space), duplicate (role and text as in an earlier row), truncated (the last such character is none of . ! ?).
    Edits are Keep (0), Rerole to user or assistant (1), Delete (2; blank and duplicate rows have to go) and Insert of an empty user or
    assistant turn (5); a truncated row that stays adds 5. The result's roles begin with an optional system turn, then user and
    assistant in turns, ended by an assistant, or there is none.

    Returns conv_id, gaps (turn numbers that are missing between the least and the largest), blank, duplicate, truncated, illegal
    (neighbours, before the repair, whose roles do not follow each other), cost, audit (the cheapest edits' initials in order, of
    these the first in ASCII order), repaired_sha256 and, with `texts`, repaired (role:text lines). Null roles and texts
    count as one space. Rows with a null conv_id are one conversation, whose id is null. Rows that repeat are duplicates. A
    conversation without rows has zeros, an empty audit and an empty text. Very long texts are taken whole. Other columns are
    not looked at. An empty table gives no rows.
    """
    small_batches(rows.sparkSession)
    t = rows.select(_conversation().alias("c"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")])
    long = t.groupBy("c").count().where(F.col("count") > LONG).select("c")
    long = written(long)
    if long.isEmpty():
        found = _short(t, texts)
    else:
        found = _short(hub_join(t, long, "c", "left_anti"), texts).unionByName(_long(hub_join(t, long, "c", "left_semi"), texts))
    kind = rows.schema["conv_id"].dataType.simpleString()
    every = (rows if ids is None else ids).select("conv_id").distinct().withColumn("c", _conversation()).withColumn("conv_id", F.col("conv_id").cast(kind))
    out = every.join(found, "c", "left").select("conv_id", *[F.coalesce(f, F.lit(0)).cast("long").alias(f) for f in FACTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"), F.coalesce("repaired", F.lit("")).alias("repaired"))
    return out if texts else out.drop("repaired")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults, chosen by the CRC-32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2
    takes its full stops, exclamation and question marks away, 3 repeats it, 4 makes its role user. Nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    x = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    x = x.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return x.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "again")
