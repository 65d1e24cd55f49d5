import hashlib

from jsonloom.llm import chat


def test_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\s>", "[INST", "]", "</s", "\\</s>\\", "[\\/INST]", "</\\s>", "", None, "[/INST\\]", "a\nb", "<s>[INST][/INST]</s></s>"]
    rows = [(i, t, role, text) for i, a in enumerate(nasty) for t, (role, text) in enumerate([("system", a), ("user", nasty[-1 - i]), ("assistant", a), ("tool", "x"), (a, "odd role"), (None, None)][: 2 + i % 5])]
    rows += [(50, 0, "user", "q"), (50, 1, "assistant", "r"), (51, 0, "user", "q"), (51, 1, "assistant", "r"), (52, 0, "assistant", "same"), (52, 0, "assistant", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = {}
    for c, t, r, x in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        want.setdefault(c, []).append((t, r or "", x or ""))
    found = {r.conv_id: r for r in chat.digests(table).collect()}
    assert set(found) == set(want)
    for c, turns in want.items():
        turns = sorted(turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_layouts(spark):
    records = spark.createDataFrame(
        [(1, "p", "c", None, None, None, 0), (2, None, None, "i", "o", None, 0), (3, None, None, None, None, [("human", "h"), ("gpt", None)], 0), (4, "p", None, "i", None, None, 0), (5, None, None, None, None, [], 0), (6, None, None, None, None, None, 0)],
        "id long, prompt string, completion string, instruction string, output string, conversations array<struct<`from`:string,value:string>>, turns int",
    )
    found = {r.record_id: r for r in chat.canonical_turns(records, "id").collect()}
    assert [(found[i].layout, [tuple(t) for t in found[i].turns]) for i in (1, 2, 3)] == [("prompt", [("user", "p"), ("assistant", "c")]), ("instruction", [("user", "i"), ("assistant", "o")]), ("share", [("user", "h"), ("assistant", "")])]
    assert found[4].layout is None and found[6].layout is None and found[5].turns == []
    assert chat.formatted(chat.canonical_turns(records, "id")).count() == 3


def test_records_of_one_id_and_clashing_names(spark):
    records = spark.createDataFrame([(1, "p", "c", "x"), (1, "q", "d", "x"), (1, "p", "c", "x"), (None, "n", "", "y")], "fingerprint long, prompt string, completion string, layout string")
    found = chat.parsed(chat.formatted(chat.canonical_turns(records, "fingerprint"))).collect()
    assert sorted((str(r.record_id), [t.text for t in r.turns], r.loss_texts) for r in found) == [("1", ["p", "c"], ["", "c"]), ("1", ["p", "c"], ["", "c"]), ("1", ["q", "d"], ["", "d"]), ("None", ["n", ""], ["", ""])]
    assert chat.formatted(chat.canonical_turns(records.limit(0), "fingerprint")).count() == 0


def test_many_turns(spark):
    turns = [("user" if i % 2 else "assistant", "😀" * (i % 7) + "</s>" * (i % 3)) for i in range(20_000)]
    made = chat.formatted(spark.createDataFrame([(1, "m", turns), (2, "m", turns[:257]), (3, "m", turns[:256]), (4, "m", turns[:1])], f"record_id long, layout string, turns {chat.TURNS}"))
    for r in chat.parsed(made).join(made.select("record_id", "masks"), "record_id").collect():
        want = turns[: len(r.turns)]
        assert [tuple(t) for t in r.turns] == want and r.loss_texts == [t if role == "assistant" else "" for role, t in want]
        at = 0
        for (role, _), m, piece in zip(want, r.masks, r.formatted.split(chat.CLOSE), strict=False):
            assert m.start == at and m.loss_start == at + len(chat.OPEN + role + chat.SPLIT)
            at += len(piece) + len(chat.CLOSE)
        assert at == len(r.formatted)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.digests(none).collect()] == [-1]


def test_plan_has_no_python(spark):
    from jsonloom.plans.inspect import plan

    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert plan(chat.digests(none)).python == 0
