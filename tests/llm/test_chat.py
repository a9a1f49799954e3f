import hashlib
import random

from rankloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, extra string, formatted int"
PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "s>", "/s>", "INST]", "\n", " ", "a", "é", "<\\s>", "<\\\\/s>", "[\\INST]", "$1", ""]


def rows_of(rows, spark):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (-(1 << 63) if r[1] is None else r[1], r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def check(spark, rows):
    found = chat.formatted_conversations(rows_of(rows, spark))
    want = expected(rows)
    got = {r["conv_id"]: r for r in found.collect()}
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == want
    for c, r in got.items():
        at, shown = 0, []
        for run in r["loss_mask"]:
            if run["on"]:
                shown.append(r["formatted"][at : at + run["chars"]])
            at += run["chars"]
        assert at == len(r["formatted"]) and len(shown) == sum(role == "assistant" for role, _ in want[c])
    for r in chat.digests(found).collect():
        turns = want[r["conv_id"]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(got[r["conv_id"]]["formatted"])


def test_conflicting_texts(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "odd\nrole", None, "[INST]"]
    rows = [(c, t, rng.choice(roles), "".join(rng.choices(PIECES, k=rng.randint(0, 9)))) for c in range(150) for t in range(rng.randint(1, 6))]
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, 0, "user", None), (1, None, "user", "first"), (1, 0, "user", None), (None, 0, "assistant", "x"), (None, 1, "assistant", ""), (2, 5, "assistant", "</s>" * 20_000)])
    assert chat.digests(chat.formatted_conversations(rows_of([], spark))).count() == 0


def test_main_path_is_native(spark):
    found = chat.digests(chat.formatted_conversations(rows_of([(1, 0, "user", "a")], spark)))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_parse_rejects_other_text(spark):
    from pyspark.sql import functions as F

    texts = ["abc", "<s>a", "<s>a[/INST]", "[INST]a</s>", "<s>a</s>tail", "<s><s>a</s>", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.parse(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got[:-1]] == [None] * 6 and got[-1]["x"] == []
