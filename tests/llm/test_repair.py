import hashlib
import re
import zlib

import numpy as np
import pytest

from tapeflow.llm import repair as module
from tapeflow.llm.repair import NONE, ROOT, Costs, advanced, damaged, finished, grown, less, repair, repaired_rows, spelled

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies string"


def cheapest(rows, costs):
    """Cost and audit by trying all edits that cost no more than deleting every row.  rows: role, forced, truncated."""
    limit = costs.delete * len(rows)
    best = [(limit, "D" * len(rows))]

    def go(i, cost, audit, roles, inserted):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, cost + costs.insert, audit + "I", roles + r, inserted + 1)
        if i < len(rows):
            role, forced, truncated = rows[i]
            go(i + 1, cost + costs.delete, audit + "D", roles, 0)
            if not forced:
                cost += costs.truncated * truncated
                go(i + 1, cost, audit + "K", roles + (role[:1] or "?"), 0)
                for r in "ua":
                    go(i + 1, cost + costs.rerole, audit + "R", roles + r, 0)

    go(0, 0, "", "", 0)
    return best[0]


@pytest.mark.parametrize("costs", [Costs(), Costs(insert=1), Costs(rerole=3, delete=3, insert=2, truncated=1), Costs(1, 4, 2, 0), Costs(2, 1, 1, 1)])
def test_paths_equal_all_edits(costs):
    rng = np.random.default_rng(sum(costs))
    for _ in range(150):
        rows = [(str(rng.choice(["user", "assistant", "system", "tool", ""])), bool(rng.random() < 0.1), bool(rng.random() < 0.2)) for _ in range(rng.integers(0, 5))]
        best = {NONE: (0, ROOT)}
        for role, forced, truncated in rows:
            best = advanced(best, role[:1], forced, truncated, costs)
        found = finished(best, costs)
        assert found == cheapest(rows, costs), rows
        roles = "".join(r[:1] for r, _ in repaired_rows(found[1], [(r, "") for r, *_ in rows]))
        assert re.fullmatch("(s?(ua)+)?", roles)


@pytest.mark.parametrize("mod", [module._MOD, 7])
def test_paths_compare_as_their_letters(monkeypatch, mod):
    monkeypatch.setattr(module, "_MOD", mod)  # a small one makes hashes collide
    rng = np.random.default_rng(4)
    paths = [ROOT]
    level = [ROOT]
    for _ in range(70):
        level = [grown(level[int(rng.integers(len(level)))], str(rng.choice(["K", "R", "D", "IK"]))) for _ in range(4)]
        paths = level
        for a in paths:
            for b in paths:
                assert less(a, b) == (spelled(a) < spelled(b))
        assert all(spelled(a.back[i]) == spelled(a)[: a.back[i].letters] and a.back[i].depth == a.depth - 2**i for a in paths for i in range(len(a.back)))


def plain(table):
    """Every conversation by itself, row by row."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text, *_ in table:
            if c != conv:
                continue
            name = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            role, text = (" " if role is None else role), (" " if text is None else text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, marks = set(), []
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            marks.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        best = {NONE: (0, ROOT)}
        for (_, role, _), m in zip(rows, marks):
            best = advanced(best, role[:1], m in ("blank", "duplicate"), m == "truncated", Costs())
        cost, audit = finished(best, Costs())
        left = "\n".join(f"{r}:{t}" for r, t in repaired_rows(audit, [r[1:] for r in rows]))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=0):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["One. ", "Two!", "Three", "  \t", "", None, "Ünï?", "a.b\n", "x.  "]
    pick = lambda xs, p=None: xs[int(rng.choice(len(xs), p=p))]
    role = [0.4, 0.38, 0.1, 0.04, 0.04, 0.04]
    rows = [(int(c), None if rng.random() < 0.05 else int(rng.integers(-3, 9)), pick(roles, role), pick(texts), "x", "y") for c in range(60) for _ in range(int(rng.integers(1, 9)))]
    for c, size in ((100, 300), (101, 40), (None, 25)):  # a long one, and one without a key
        rows += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 5 else "Again.", "x", "y") for t in range(size)]
    rows += [rows[-1]] * 30  # repeated rows
    rows += [(102, 5, "user", "long. " * 20_000, "x", "y"), (103, None, None, None, "x", "y")]
    return rows


@pytest.mark.parametrize("parts, most", [(1, 4096), (7, 4096), (5, 3)])
def test_rows_equal_a_loop(spark, parts, most):
    rows = conversations()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair(damaged(spark.createDataFrame(rows, SCHEMA).repartition(3)), most_rows=most).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, found), key=str) == plain(rows)


def test_empty_table_and_dropped_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair(damaged(none)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair(damaged(spark.createDataFrame([(gone, 0, "user", "Hi.", "", "")], SCHEMA))).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
