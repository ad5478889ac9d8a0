"""Repaired conversations against all edits, and against a plain search over rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np

from fairtract.llm import dialogue

GOOD = re.compile(r"(s?(ua)+)?\Z")
SCHEMA = "conv_id long, turn long, role string, text string, slice string, digest int"


def plain_damage(rows):
    """Damaged rows of each conversation; rows are (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    return {c: in_order(own) for c, own in out.items()}


def in_order(rows):
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def choices(row, fault):
    """(cost, letter, role) of what may become of a row."""
    yield 4, "D", None
    if fault in ("blank", "duplicate"):
        return
    extra = 3 if fault == "truncated" else 0
    yield extra, "K", row[1]
    for role in ("user", "assistant"):
        yield 3 + extra, "R", role


def search(rows):
    """The cheapest edits by a plain walk over rows and states; states are initials read so far, folded."""
    state_of = lambda s: s if len(s) < 2 else "a" if s[-1] == "a" else "u"
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        for _ in range(4):
            for s, (cost, audit) in list(best.items()):
                for role in "ua":
                    if role in step[s]:
                        new = (cost + 3, audit + "I")
                        best[role] = min(best.get(role, new), new)
        return best

    best = inserted({"": (0, "")})
    for row, fault in zip(rows, faults(rows)):
        after = {}
        for s, (cost, audit) in best.items():
            for extra, letter, role in choices(row, fault):
                to = s if role is None else role[:1] if role[:1] and role[:1] in step[s] else None
                if to is not None:
                    new = (cost + extra, audit + letter)
                    after[to] = min(after.get(to, new), new)
        best = inserted(after)
    assert state_of("ua") == "a"
    return min(best[s] for s in ("", "a") if s in best)


def every(rows, most_inserted):
    """The cheapest of all edits, tried one by one."""
    found = []
    options = [list(choices(r, f)) for r, f in zip(rows, faults(rows))]
    gaps = len(rows) + 1
    for picked in itertools.product(*options):
        for inserts in itertools.product(range(most_inserted + 1), repeat=gaps):
            if sum(inserts) > most_inserted:
                continue
            for roles in itertools.product("ua", repeat=sum(inserts)):
                left, audit, initials, cost = list(roles), "", "", 0
                for i in range(gaps):
                    audit += "I" * inserts[i]
                    initials += "".join(left.pop(0) for _ in range(inserts[i]))
                    cost += 3 * inserts[i]
                    if i < len(rows):
                        extra, letter, role = picked[i]
                        cost, audit = cost + extra, audit + letter
                        initials += (role[:1] or "?") if role is not None else ""
                if GOOD.match(initials):
                    found.append((cost, audit))
    return min(found)


def plain(rows):
    out = {}
    for conv, own in plain_damage(rows).items():
        turns = [t for t, _, _ in own if t is not None]
        kinds = faults(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = search(own)
        left, lines = iter(own), []
        size = len(audit) - audit.count("D")
        for letter in audit:
            row = None if letter == "I" else next(left)
            if letter == "D":
                continue
            place = len(lines) - size % 2
            role = row[1] if letter == "K" else ("user", "assistant")[place % 2]
            lines.append(f"{role}:{row[2] if row else ''}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def made_up(n, seed, long=0):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in range(n):
        size = int(rng.integers(1, 9)) if conv or not long else long
        for turn in range(size):
            role = str(rng.choice(["user", "assistant", "system", "tool", "", "umpire"], p=[0.4, 0.35, 0.1, 0.05, 0.05, 0.05]))
            text = str(rng.choice(["Yes.", "No", "", " \t", "Why?", "Well... ", "é!", f"t{rng.integers(99)}."]))
            rows.append((conv, turn + int(rng.integers(0, 3)), role, text))
    return rows


def test_cells_hold_the_cheapest_of_all_edits():
    rng = np.random.default_rng(3)
    for _ in range(60):
        rows = [(0, str(rng.choice(["user", "assistant", "system", "tool"])), str(rng.choice(["a.", "b.", "c", ""]))) for _ in range(rng.integers(0, 4))]
        cells = [dialogue.row_cells(r if (r := row[1][:1]) in "sua" else "", f in ("blank", "duplicate"), f == "truncated") for row, f in zip(rows, faults(rows))]
        assert dialogue.cheapest(dialogue.parse(cells)) == every(rows, 3) == search(rows)


def test_any_split_gives_the_same_cells():
    rng = np.random.default_rng(4)
    cells = [dialogue.row_cells(str(rng.choice(["s", "u", "a", ""])), bool(rng.random() < 0.2), bool(rng.random() < 0.3)) for _ in range(40)]
    whole = dialogue.parse(list(cells))
    for cut in range(1, 40):
        assert dialogue.join(dialogue.parse(cells[:cut]), dialogue.parse(cells[cut:])) == whole


def test_query_equals_plain_version(spark):
    from fairtract.llm.queries import op13_dialogue_repair

    for sf in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{sf}"
        rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert result(op13_dialogue_repair(spark, path)) == plain(rows)


def test_odd_conversations(spark):
    """Long ones over several slices, nulls in every column, ties, repeated rows, columns of helper names."""
    rows = made_up(200, 1, long=3_000)
    rows += [(None, 1, "user", "a."), (None, 2, None, None), (None, None, "user", "b."), (7_000, None, None, None), (7_001, 5, "user", "x")]
    rows += [(8_000, 1, "user", "same.")] * 40 + [(8_001, None, "assistant", None)] * 3
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA).repartition(7)
    assert result(dialogue.repair(dialogue.damage(df))) == plain(rows)
    assert dialogue.repair(dialogue.damage(df.limit(0))).count() == 0


def test_repaired_rows_read_well(spark):
    damaged = dialogue.damage(spark.createDataFrame([(*r, "s", 1) for r in made_up(100, 2)], SCHEMA))
    verdicts = dialogue.audits(damaged)
    roles, hashes = {}, result(dialogue.repair(damaged))
    lines = dialogue.repaired(damaged, verdicts).orderBy("conv_id", "place").collect()
    for r in lines:
        roles.setdefault(r.conv_id, []).append(r)
    for conv, own in roles.items():
        assert GOOD.match("".join(r.role[:1] for r in own)) and [r.place for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == hashes[conv][-1]
