"""Repair of conversations against trying all edits."""

import hashlib
import random
import zlib

from kerbside.llm import conversations as C

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string"


def damaged(rows):
    """What the contract says of damage, row by row, in the order of turns."""
    out = {}
    for conv_id, turn, role, text, *_ in rows:
        found = out.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        found += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)

    def place(row):
        turn, role, text = row
        return (turn is not None, turn or 0, role.encode(), hashlib.md5(f"{len(role)}:{role}:{text}".encode()).digest())

    return {k: sorted(v, key=place) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least cost, least initials and the repaired rows, by trying every edit at every place."""
    best = {}

    def ends(state):
        return {"": 0, "a": 0, "s": 6, "u": 3}[state]

    def go(k, state):
        """(cost, initials, repaired) of what follows; ``state`` is the last role's initial."""
        if (k, state) in best:
            return best[k, state]
        made = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        found = []

        def add(cost, edit, row, rest):
            found.append((cost + rest[0], edit + rest[1], ([row] if row else []) + rest[2]))

        def without_insert(k, state):
            if k == len(rows):
                return [] if state in ("s", "u") else [(0, "", [])]
            (_, role, text), mark, out = rows[k], marks[k], []
            rest = go(k + 1, state)
            out.append((4 + rest[0], "D" + rest[1], rest[2]))
            if mark in (None, "truncated"):
                extra = 3 if mark else 0
                initial = role[:1]
                if (state, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    rest = go(k + 1, initial)
                    out.append((extra + rest[0], "K" + rest[1], [f"{role}:{text}", *rest[2]]))
                to = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
                rest = go(k + 1, to[0])
                out.append((extra + 3 + rest[0], "R" + rest[1], [f"{to}:{text}", *rest[2]]))
            return out

        found += without_insert(k, state)
        inserted, at = [], state
        for _ in range(3):
            made = {"": "user", "s": "user", "u": "assistant", "a": "user"}[at]
            inserted.append(f"{made}:")
            at = made[0]
            found += [(3 * len(inserted) + c, "I" * len(inserted) + e, inserted + r) for c, e, r in without_insert(k, at)]
        best[k, state] = min(found, key=lambda f: (f[0], f[1]))
        return best[k, state]

    return go(0, "")


def expected(rows):
    out = {}
    for conv_id, found in damaged(rows).items():
        marks = faults(found)
        cost, audit, repaired = cheapest(found, marks)
        turns = [t for t, _, _ in found if t is not None]
        initials = [role[:1] for _, role, _ in found]
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def some_rows(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for conv_id in range(conversations):
        for turn in range(draw.randint(1, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "agent", None])
            text = draw.choice(["Yes.", "No!", "cut", " \t", "", None, "é?", "Well. ", "a: b.", f"{draw.random()}.", f"t{draw.random()}."])
            if draw.random() < 0.95:
                rows.append((conv_id if conv_id % 13 else None, turn if draw.random() < 0.97 else None, role, text, "x"))
    draw.shuffle(rows)
    return rows


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_against_all_edits(spark):
    rows = some_rows(1, 300, 12)
    assert found(C.repair_digests(C.damage(spark.createDataFrame(rows, SCHEMA)))) == expected(rows)


def test_pointers_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 3)
    rows = some_rows(2, 40, 60) + [(7, 5, "user", "Same.", "")] * 20
    assert found(C.repair_digests(C.damage(spark.createDataFrame(rows, SCHEMA)))) == expected(rows)


def test_repaired_rows_read_as_the_grammar_says(spark):
    rows = C.damage(spark.createDataFrame(some_rows(3, 100, 15), SCHEMA))
    digests = found(C.repair_digests(rows))
    edits = {}
    for r in sorted(C.repair(rows).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["step"])):
        edits.setdefault(r["conv_id"], []).append(r)
    for conv_id, found_edits in edits.items():
        assert [r["step"] for r in found_edits] == list(range(len(found_edits)))
        assert "".join(r["edit"] for r in found_edits) == digests[conv_id][6]
        repaired = [f"{r['role']}:{r['text']}" for r in found_edits if r["edit"] != "D"]
        assert hashlib.sha256("\n".join(repaired).encode()).hexdigest() == digests[conv_id][7]


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_digests(C.damage(empty)).count() == C.repair(C.damage(empty)).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = C.damage(spark.createDataFrame([(dropped, 0, "user", "Yes.", "")], SCHEMA))
    assert found(C.repair_digests(rows)) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
