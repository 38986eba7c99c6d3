import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featurelens.llm import conversation_repair as cr
from featurelens.llm import queries

SF_SMALL = "/root/testdata/sf0.001"

ROWS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", " "]),
                          st.sampled_from(["a.", "b.", "c", "", " \n", "d?", "e! ", "f"])), max_size=5)


def plain_faults(rows):
    for i, (role, text) in enumerate(rows):
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        yield ("blank" if not solid else "duplicate" if (role, text) in rows[:i]
               else "truncated" if solid[-1] not in ".!?" else "")


def plain(rows):
    """The least (cost, audit) and its rows, by trying all edits on whole strings."""
    fault, best = list(plain_faults(rows)), []

    def go(i, out, cost, audit):
        written = "".join(role[:1] for role, _ in out)
        if not re.fullmatch("s?(ua)*u?", written) or best and cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", written):
            best[:] = [min([(cost, audit, out), *best])]
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                go(i, [*out, (role, "")], cost + 3, audit + "I")
        if i < len(rows):
            go(i + 1, out, cost + 4, audit + "D")
            if fault[i] not in ("blank", "duplicate"):
                more = 3 * (fault[i] == "truncated")
                if rows[i][0]:
                    go(i + 1, [*out, rows[i]], cost + more, audit + "K")
                for role in ("user", "assistant"):
                    go(i + 1, [*out, (role, rows[i][1])], cost + 3 + more, audit + "R")

    go(0, [], 0, "")
    return best[0]


def whole(rows):
    """The same for longer conversations: whole strings per row and state."""
    best = {"": (0, "")}
    state = {"": "", "s": "s", "u": "u", "a": "a"}
    follow = {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    def inserted(b):
        for to, frm in (("u", ("", "s", "a")), ("a", ("u",))):
            offers = [(b[f][0] + 3, b[f][1] + "I") for f in frm if f in b]
            b[to] = min([*offers, *([b[to]] if to in b else [])])
        return b

    best = inserted(best)
    for (role, _), fault in zip(rows, plain_faults(rows), strict=True):
        new = defaultdict(list)
        for f, (cost, audit) in best.items():
            new[f].append((cost + 4, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            for to in "sua":
                if (f, to) in follow:
                    if role[:1] == to:
                        new[state[to]].append((cost + more, audit + "K"))
                    if to != "s":
                        new[state[to]].append((cost + 3 + more, audit + "R"))
        best = inserted({k: min(v) for k, v in new.items()})
    return min(best[k] for k in ("", "a") if k in best)


@given(ROWS, st.sampled_from([cr.PRIME, 2, 7]))  # small primes make hashes collide
@settings(max_examples=250, deadline=None)
def test_against_all_edits(rows, prime):
    programme = cr.Repair(prime)
    for (role, _), fault in zip(rows, cr.faults(rows), strict=True):
        programme.row(role, fault)
    cost, audit = programme.result()
    expect = plain(rows)
    assert list(cr.faults(rows)) == list(plain_faults(rows))
    assert (cost, audit) == expect[:2] and cr.applied(rows, audit) == expect[2]


@given(st.text("DIKR", max_size=40), st.text("DIKR", max_size=40), st.integers(0, 20), st.sampled_from([cr.PRIME, 2]))
@settings(max_examples=300, deadline=None)
def test_audits_compare_as_text(a, b, shared, prime):
    b = a[:shared] + b
    root = cr.Edit()
    nodes = []
    for text in (a, b):
        edit = root
        for c in text:
            edit = cr.Edit(c, edit, prime)
        nodes.append(edit)
        assert edit.edits() == text and all(edit.at(d).edits() == text[:d] for d in range(len(text) + 1))
    assert cr.less(*nodes) == (a < b) and cr.same(nodes[0].at(0), nodes[1].at(0))


def test_table(rows):
    data = [(1, 2, "assistant", "x."), (1, 0, "user", "hello."), (1, 5, "user", "more."), (2, None, None, None),
            (None, 1, "user", "a."), (None, 1, "user", "a."), (None, 2, "assistant", "b"), (3, 0, "system", "s.")]
    frame = rows.frame([(*d, 9) for d in data], "conv_id int, turn int, role string, text string, cost int")
    got = {r["conv_id"]: r for r in rows.dicts(cr.repair(frame))}
    assert set(got) == {1, 2, None, 3}
    assert got[1]["gaps"] == 3 and got[1]["audit"] == "KKKI" and got[1]["cost"] == 3
    assert [tuple(m) for m in got[1]["repaired"]][-1] == ("assistant", "")
    assert (got[2]["gaps"], got[2]["blank"], got[2]["audit"], got[2]["repaired"]) == (0, 1, "D", [])
    assert (got[None]["duplicate"], got[None]["truncated"], got[None]["illegal"], got[None]["audit"]) == (1, 1, 1, "KDK")
    assert got[3]["audit"] == "D" and got[3]["cost"] == 4
    assert rows.dicts(cr.repair(frame.limit(0))) == []


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        what = zlib.crc32(":".join(shown).encode()) % 20
        role, text = role or " ", " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
    return out


@pytest.mark.parametrize("folder", [SF_SMALL])
def test_query(spark, folder):
    source = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    by_conv = {c: [] for c, *_ in source}
    for conv, *row in sorted(harmed(source)):
        by_conv[conv].append(row)
    got = {r["conv_id"]: r for r in queries.op13_conversation_repair(spark, folder).collect()}
    assert set(got) == set(by_conv)
    for conv, turned in by_conv.items():
        rows, r = [(role, text) for _, role, text in turned], got[conv]
        fault, turns = list(plain_faults(rows)), {t for t, *_ in turned}
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [fault.count(f) for f in ("blank", "duplicate", "truncated")]
        assert r["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        assert (r["cost"], r["audit"]) == whole(rows)
        text = "\n".join(f"{a}:{b}" for a, b in cr.applied(rows, r["audit"]))
        assert r["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
