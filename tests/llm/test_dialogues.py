import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tokenloom.llm import dialogues

SCHEMA = "conv_id long, turn long, role string, text string, audit string, marker int, digest string"
LONG = (1 << 63) - 1


def damaged_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        code = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def faults(rows):
    """Letters of the first fault of each row of a sorted conversation."""
    out, seen = [], set()
    for _, _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def all_repairs(rows):
    """Every script of edits with up to two inserts in a place, tried out."""
    marks = faults(rows)
    best = None
    for letters in product("DKR", repeat=len(rows)):
        if any(m in ("b", "d") and x != "D" for m, x in zip(marks, letters)):
            continue
        for gaps in product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, [*letters, ""]))
            cost = 3 * sum(gaps) + sum({"D": 4, "K": 0, "R": 3}[x] + (3 if m == "t" and x != "D" else 0) for m, x in zip(marks, letters))
            if best and (cost, audit) >= best[:2]:
                continue
            for roles in product(("user", "assistant"), repeat=sum(gaps) + letters.count("R")):
                made, lines, it = "", [], iter(roles)
                for g, x, row in zip(gaps, [*letters, ""], [*rows, None]):
                    new = [(next(it), "") for _ in range(g)]
                    if x == "K":
                        new.append(row[2:])
                    if x == "R":
                        new.append((next(it), row[3]))
                    lines += new
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                    best = cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)
                    break
    return best


def key(row):
    return row[1] is not None, row[1] or 0, row[2], row[3]


def by_hand(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv), key=key)
        marks, turns = faults(mine), [r[1] for r in mine if r[1] is not None]
        gaps = min(LONG, max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, text = all_repairs(mine)
        out[conv] = (gaps, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed=11, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for _ in range(rng.randint(1, 4)):
            turn = rng.choice([None, 0, 1, 1, 2, 3, 7])
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, turn, role, rng.choice(["Yes.", "no", "Why?", " \t\n", "", None, "a\nb!", "ü…", "Yes.", "x" * 5000 + "."])))
    rows += [(500, -(1 << 63), "user", "a."), (500, LONG, "assistant", "b.")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def test_undamaged_conversations_equal_all_scripts_tried(spark):
    rows = conversations()
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert result(dialogues.repair(frame(spark, rows).repartition(7))) == by_hand(clean, {r[0] for r in rows})


def test_damaged_conversations_equal_all_scripts_tried(spark):
    rows = conversations(12, 150)
    turns = frame(spark, rows)
    damaged = damaged_by_hand(rows)
    lost = {r[0] for r in rows} - {r[0] for r in damaged}
    small = [r for r in rows if sum(x[0] == r[0] for x in damaged) < 6]
    want = by_hand(damaged, {r[0] for r in small})
    got = result(dialogues.repair(dialogues.damage(turns), ids=turns))
    assert {k: got[k] for k in want} == want and set(got) == {r[0] for r in rows}
    assert lost and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost)


def test_a_giant_conversation_spills_and_crosses_batches(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("assistant" if rng.random() < 0.5 else "user", rng.choice(["a.", "b", "c!", " ", f"{i}."])) for i in range(3000)]
    one, two = dialogues.Repair(), dialogues.Repair(limit=64)
    for role, text in rows:
        for r in (one, two):
            r.row(role, text, not text.strip(), text == "b")
    assert two.back.file is not None and one.back.file is None
    assert one.end() == two.end()
    monkeypatch.setattr(dialogues, "small_batches", lambda s: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = dialogues.repair(frame(spark, [(1, i, *r) for i, r in enumerate(rows)])).collect()
        turns = dialogues.repaired_turns(frame(spark, [(1, i, *r) for i, r in enumerate(rows)] + [(2, 0, "system", "s."), (3, 1, "tool", "")])).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 1 and len(got[0].audit) >= 3000
    mine = sorted((r for r in turns if r.conv_id == 1), key=lambda r: r.place)
    assert [r.place for r in mine] == list(range(len(mine)))
    assert re.fullmatch("(ua)+", "".join(r.role[0] for r in mine))
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine).encode()).hexdigest() == got[0].repaired_sha256
    assert "".join(r.edit for r in mine) == got[0].audit.replace("D", "")
    assert sorted((r.conv_id, r.place, r.role, r.edit) for r in turns if r.conv_id != 1) == []  # deleting costs less


def test_repaired_turns_of_many_conversations(spark):
    rows = conversations(13, 40)
    digests = result(dialogues.repair(frame(spark, rows)))
    turns = dialogues.repaired_turns(frame(spark, rows)).collect()
    for conv, want in digests.items():
        mine = sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.place)
        text = "\n".join(f"{r.role}:{r.text}" for r in mine)
        assert hashlib.sha256(text.encode()).hexdigest() == want[-1]
        assert "".join(r.edit for r in mine) == want[-2].replace("D", "")


def test_no_rows(spark):
    turns = frame(spark, [])
    assert result(dialogues.repair(dialogues.damage(turns), ids=turns)) == {}
    assert dialogues.repaired_turns(turns).collect() == []


@pytest.mark.parametrize("rows, audit", [([("user", "a.")], "KI"), ([("system", "a.")], "D"), ([("system", "a."), ("user", "b."), ("assistant", "c.")], "KKK"), ([("assistant", "a.")], "IK"), ([], "")])
def test_cheapest_edits(rows, audit):
    r = dialogues.Repair()
    for role, text in rows:
        r.row(role, text, False, False)
    assert r.end()[1] == audit
