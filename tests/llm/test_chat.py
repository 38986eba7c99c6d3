import hashlib

from pyspark.sql import functions as F

from featurelens.llm import chat

HOSTILE = ["", "\\", "\\s", "<|", "<\\p", "<|im_end|>", "<|im_start|>assistant\nx", "a\\n<|\\p|>", "\\\\s<", "<<||", "é😀<|im_end|>\n"]


def test_round_trip_of_hostile_texts(rows):
    data = [(c, t, r, x) for c, shift in enumerate(range(4)) for t, (r, x) in enumerate(
        zip(["user", "assistant", "sys\ntem", "<|im_end|>", "assistant", None, "\\n", "user", "assistant", "a", "assistant"],
            HOSTILE[shift:] + HOSTILE[:shift], strict=True))]
    made = chat.render(chat.fold(chat.events_of(rows.frame(data, "conv_id long, turn long, role string, text string"))))
    got = made.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                      chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in got:
        mine = [(x[2] or "", x[3]) for x in data if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == mine
        assert r["loss"] == "".join(t for role, t in mine if role == "assistant")
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == len(mine)


def folded(log):
    """The messages of one conversation, event by event."""
    messages = {}
    for _, kind, m, role, text in log:
        text = text or ""
        if kind == "regenerate":
            messages = {k: v for k, v in messages.items() if k <= m}
        old = messages.get(m)
        if kind == "delta":
            messages[m] = (old[0] if old else None, (old[1] if old else "") + text)
        elif kind in ("message", "edit", "regenerate"):
            messages[m] = (role if role is not None else old and old[0], text)
    return [(m, r or "", t) for m, (r, t) in sorted(messages.items())]


def test_fold_of_deltas_edits_and_regenerations(rows):
    import random
    r = random.Random(4)
    logs = {}
    for c in range(60):
        logs[c] = [(s, r.choice(["message", "delta", "delta", "edit", "regenerate", "ping"]), r.randrange(4),
                    r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None])) for s in range(r.randrange(1, 14))]
    data = [(c, *e) for c, log in logs.items() for e in log]
    r.shuffle(data)
    frame = rows.frame(data, "conv_id long, seq long, event string, message long, role string, text string")
    got = {}
    for x in chat.fold(frame).orderBy("__conv", "__message").collect():
        got.setdefault(x["__conv"], []).append((x["__message"], x["__role"], x["__text"]))
    assert got == {c: f for c, log in logs.items() if (f := folded([e for e in log if e[1] != "ping"]))}


def test_edge_rows(rows):
    data = [(None, 1, "user", "x", 1), (7, None, "assistant", None, 1), (7, 2, None, "t", 1), (7, 2, None, "t", 1), (7, 2, "a", "s", 1)]
    frame = rows.frame(data, "conv_id long, turn long, role string, text string, formatted int")
    made = {r["conv_id"]: r for r in chat.render(chat.fold(chat.events_of(frame))).collect()}
    assert made[None]["formatted"] == "<|im_start|>user\nx<|im_end|>\n"
    assert made[7]["formatted"].count(chat.START) == 4
    assert [tuple(s) for s in made[7]["loss_spans"]] == [(len("<|im_start|>assistant\n"), 0)]
    assert chat.render(chat.fold(chat.events_of(frame.limit(0)))).count() == 0


def test_long_conversation(rows):
    data = [(1, i, "assistant" if i % 2 else "user", f"text {i} " * 20) for i in range(1500)]
    frame = rows.frame(data, "conv_id long, turn long, role string, text string")
    r = chat.render(chat.fold(chat.events_of(frame))).select(
        F.sha2(chat.under_loss(F.col("formatted"), F.col("loss_spans")), 256).alias("h")).first()
    assert r["h"] == hashlib.sha256("".join(d[3] for d in data if d[1] % 2).encode()).hexdigest()
