import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from helpers import from_files

pytest.importorskip("plumbline.llm")
from plumbline.llm import repair  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
VISIBLE = re.compile("[^\x20\x09-\x0d]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm = zlib.crc32(key.encode()) % 20
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        role = "user" if harm == 4 else role
        out += [(conv, turn, role, text)] * (2 if harm == 3 else 1)
    return out


def faults_of(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        visible = VISIBLE.findall(text)
        if not visible:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, faults):
    """Least (cost, letters) of all edits, by trying each at every turn; letters decide ties."""

    @lru_cache(None)
    def best(i, shape):
        due = "assistant" if shape == "u" else "user"
        options = []
        if i == len(rows) and shape in ("", "a"):
            options.append((0, "", ()))

        def add(cost, letter, rest, turn=None):
            options.append((cost + rest[0], letter + rest[1], ((turn,) if turn else ()) + rest[2]))

        # More than two inserts in a row never pay.
        if shape[-2:] != "II":
            add(2, "I", best_after_insert(i, due[0]), (due, ""))
        if i < len(rows):
            _, _, role, text = rows[i]
            add(3, "D", best(i + 1, shape))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                if (role[:1] == "s" and shape == "") or role[:1] == due[0]:
                    add(extra, "K", best(i + 1, role[0]), (role, text))
                for other in ("user", "assistant"):
                    if other == due:
                        add(2 + extra, "R", best(i + 1, due[0]), (due, text))
        return min(options, key=lambda o: (o[0], o[1]))

    @lru_cache(None)
    def best_after_insert(i, shape, depth=1):
        """As ``best``, with at most three inserts in a row."""
        due = "assistant" if shape == "u" else "user"
        options = []
        if i == len(rows) and shape == "a":
            options.append((0, "", ()))
        if depth < 3:
            rest = best_after_insert(i, due[0], depth + 1)
            options.append((2 + rest[0], "I" + rest[1], ((due, ""),) + rest[2]))
        if i < len(rows):
            _, _, role, text = rows[i]
            rest = best(i + 1, shape)
            options.append((3 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                rest = best(i + 1, due[0])
                if role[:1] == due[0]:
                    options.append((extra + rest[0], "K" + rest[1], ((role, text),) + rest[2]))
                options.append((2 + extra + rest[0], "R" + rest[1], ((due, text),) + rest[2]))
        return min(options, key=lambda o: (o[0], o[1])) if options else (10**9, "", ())

    return best(0, "")


def brute(given):
    rows = damaged(given)
    out = {}
    for conv in {r[0] for r in given}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        faults = faults_of(mine)
        cost, audit, repaired = cheapest(mine, faults) if mine else (0, "", ())
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        text = "\n".join(f"{role}:{text}" for role, text in repaired)
        out[conv] = (
            gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def run(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    found = repair.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("seed", range(4))
def test_random_conversations(spark, tmp_path, seed):
    turn = random.Random(seed)
    texts = ["Yes.", "No!", "and then", " ", "Why?  ", "so\n", "", "x" * 50]
    roles = ["system", "user", "assistant", "tool", "User", "sage"]
    rows = []
    for conv in range(120):
        for place in range(turn.randrange(1, 11)):
            if turn.random() < 0.9:
                rows.append((conv, place, turn.choice(roles), turn.choice(texts) + turn.choice(["", "", f"{place}"])))
    assert run(spark, tmp_path, rows) == brute(rows)


def test_messy_rows(spark, tmp_path):
    rows = [
        (None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (1, None, None, None), (1, None, "user", "A."),
        (1, 5, "assistant", None), (1, 5, "user", "B."), (2, 3, "", "C."), (3, -4, "system", "S."), (3, 9, "user", "U"),
        (4, 1, "user", "漢字é。"), (4, 2, "assistant", "long " * 50_000 + "."), (5, 7, "user", "same."),
        (5, 7, "user", "same."), (5, 8, "assistant", "done."), (6, 1, "system", "only a system turn."),
        (7, 2**62, "user", "far."), (7, -(2**62), "user", "away."),
    ]
    wide = [(*r, "x", 1, 2, "e", "t") for r in rows]
    schema = SCHEMA + ", conv string, part long, place long, edits string, tie string"
    found = run(spark, tmp_path, wide, schema)
    wanted = brute(rows)
    # An empty role has no letter, so it stands for no role.
    assert {k: v for k, v in found.items() if k != 2} == {k: v for k, v in wanted.items() if k != 2}
    assert 2 in found


def test_dropped_and_empty(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert run(spark, tmp_path, [(gone, 0, "user", "Hi.")]) == {gone: empty}
    assert run(spark, tmp_path, []) == {}


def test_long_conversation_spills(spark, monkeypatch):
    """More turns than a batch and than is held: costs and texts must not depend on either."""
    turn = random.Random(9)
    rows = [
        (1, i, turn.choice(["user", "assistant", "tool"]), turn.choice(["Yes.", "no", f"{i}.", f"{i}"]))
        for i in range(3000)
    ]
    rows += [(2, i, "user", f"{i}!") for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)

    def all_of():
        plans, repaired = repair.repair_conversations(df)
        parts = sorted((r.conv_id, r.part, r.edits) for r in plans.collect())
        edits = {c: "".join(e for k, _, e in parts if k == c) for c in (1, 2)}
        return edits, sorted(map(tuple, repaired.collect())), len(parts)

    whole, turns, n = all_of()
    assert n == 2
    monkeypatch.setattr(repair, "_HELD", 64)
    monkeypatch.setattr(repair, "_PART", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        again, same, n = all_of()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert (again, same) == (whole, turns) and n > 30
    # The repaired turns follow the pattern and the letters say how they came about.
    for conv in (1, 2):
        mine = [t for t in turns if t[0] == conv]
        assert [t[1] for t in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t[4][0] for t in mine))
        assert "".join(t[2] for t in mine) == whole[conv].replace("D", "")


def test_the_tables_are_small():
    tables = repair.make_tables()
    assert len(tables.costs) < 28 and len(tables.step) == 9 * len(tables.costs)


def test_query_equals_brute_force_and_sql(spark):
    given = [tuple(r) for r in from_files(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows = repair.op11_conversation_repair(spark, SF).collect()
    assert {r.conv_id: tuple(r)[1:] for r in rows} == brute(given)
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
        assert sorted(connection.execute(repair.SQL).fetchall()) == sorted(map(tuple, rows))
