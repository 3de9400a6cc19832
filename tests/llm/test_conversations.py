"""Conversation repair against exhaustive search in plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from recordloom.llm import conversations
from recordloom.llm.queries import op13_conversation_repair

SF = "/root/testdata/sf0.01"
NONSPACE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        for _ in range(2 if fault == 3 else 1):
            yield conv, turn, role, text


def best(turns):
    """Cheapest edits of [(role, text, must go, truncated)] by search over (cost, audit): the first finished one is the answer."""
    queue, done = [(0, "", 0, "", ())], {}
    while queue:
        cost, audit, at, shape, out = heapq.heappop(queue)
        if at == len(turns) and re.fullmatch(r"(s?(ua)+)?", shape):
            return cost, audit, "\n".join(out)
        tail = shape[-1:] if len(shape) > 1 or shape != "s" else "s"
        if done.get((at, tail), (cost, audit)) < (cost, audit):
            continue
        done[at, tail] = (cost, audit)

        def step(price, letter, after, role=None, text=None):
            grown = shape + (role[:1] if role is not None else "")
            if role is not None and (not role or not re.fullmatch(r"s?(ua)*u?", grown)):
                return
            heapq.heappush(queue, (cost + price, audit + letter, after, grown, (*out, f"{role}:{text}") if role is not None else out))

        for new in ("user", "assistant"):
            step(2, "I", at, new, "")
        if at < len(turns):
            role, text, gone, cut = turns[at]
            step(3, "D", at + 1)
            if not gone:
                step(cut, "K", at + 1, role, text)
                for new in ("user", "assistant"):
                    step(2 + cut, "R", at + 1, new, text)


def plain(rows, damaged=True):
    convs = {r[0]: [] for r in rows}
    for r in damage(rows) if damaged else [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]:
        convs[r[0]].append(r[1:])
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        blank = duplicate = truncated = 0
        seen, marked = set(), []
        for _, role, text in turns:
            bare = NONSPACE.findall(text)
            gone = cut = False
            if not bare:
                blank, gone = blank + 1, True
            elif (role, text) in seen:
                duplicate, gone = duplicate + 1, True
            elif bare[-1] not in ".!?":
                truncated, cut = truncated + 1, True
            seen.add((role, text))
            marked.append((role, text, gone, int(cut)))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(f"{a[1][:1]}{b[1][:1]}" not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, text = best(marked)
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, text)
    return out


def found(frame):
    return {r.conv_id: tuple(r[c] for c in conversations.RESULTS) for r in frame.collect()}


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {k: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for k, v in plain(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in op13_conversation_repair(spark, SF).collect()}
    assert got == want and len(got) == 100


def odd_rows(n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "us", " "]
    texts = ["Yes.", "No", "Wé?", "", " \n", None, "end!  ", "a\x85", "é"]
    rows = []
    for conv in [*range(n), None]:
        for k in range(rng.randrange(0, 9)):
            rows.append((conv, rng.choice([k, k, k, k + 5, None, 2]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)))
    return rows + rows[:3]


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 2])
def test_odd_rows(spark, segment, monkeypatch):
    rows = odd_rows(120, 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        frame = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, `a.b` string, place int").repartition(3)
        assert found(conversations.repair(conversations.damaged(frame), segment)) == plain(rows)
        assert found(conversations.repair(frame.filter("conv_id % 5 = 1"), segment)) == plain([r for r in rows if r[0] is not None and r[0] % 5 == 1], damaged=False)
        assert found(conversations.repair(frame.limit(0), segment)) == {}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_conversation_with_a_third_of_all_rows(spark):
    """Whole and in segments of 50 turns: the same; half of its turns are equal."""
    rng = random.Random(1)
    rows = [(None if k % 3 == 0 else k // 9, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Same.", f"text {k}", f"Text {k}!"])) for k in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    whole = found(conversations.repair(frame))
    assert whole == found(conversations.repair(frame, 50)) and len(whole[None][6]) >= 1000


def test_ties_take_the_least_string():
    """u u: delete (3) or insert between and after (4) or re-role the second (2)."""
    assert best([("user", "a.", False, 0), ("user", "b.", False, 0)])[:2] == (2, "KR")
    assert best([("assistant", "a.", False, 0)])[:2] == (2, "IK")
    assert best([("tool", "a", False, 1)])[:2] == (3, "D")
