"""Preference formatting against the statement, a plain loop and hand-made cases."""

from tests.compare import compare, duck

from fogon.llm import preferences, queries


def test_query_equals_the_statement(spark):
    sf_dir = "/root/testdata/sf0.01"
    equal, message = compare(
        spark, duck(sf_dir), sf_dir, "op6", queries.op6_preferences, preferences.SQL
    )
    assert equal, message


def by_hand(rows):
    """Rows (pair_id, side, turn, role, text) formatted by loops."""
    def order(t):
        return tuple((x is not None, x if x is not None else "") for x in t)

    pairs = {}
    for pair, side, *turn in set(rows):
        pairs.setdefault(pair, {"chosen": [], "rejected": []})[side].append(tuple(turn))
    out = []
    for pair, sides in pairs.items():
        turns = {s: [(r or "user", t or "") for _, r, t in sorted(x, key=order)] for s, x in sides.items()}
        n = 0
        while n < min(map(len, turns.values())) and turns["chosen"][n] == turns["rejected"][n]:
            n += 1

        def render(part):
            text, spans = "", []
            for role, body in part:
                text += f"<|{role}|>\n"
                body = body.replace("<|", "< |") + "<|end|>"
                if role == "assistant":
                    spans.append(f"{len(text)}:{len(body)}")
                text += body + "\n"
            return text, ",".join(spans)

        chosen, rejected = render(turns["chosen"][n:]), render(turns["rejected"][n:])
        out.append((pair, n, render(turns["chosen"][:n])[0], chosen[0], rejected[0], chosen[1], rejected[1]))
    return sorted(out, key=str)


CASES = [
    (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"),
    (1, "rejected", 1, "assistant", "bad <|end|> <|x"), (1, "rejected", 1, "assistant", "bad <|end|> <|x"),
    (2, "chosen", 0, "user", "same"), (2, "rejected", 0, "user", "same"),  # no completion
    (3, "chosen", 5, "assistant", "only one side"),
    (4, "rejected", None, None, None), (4, "chosen", None, None, None), (4, "chosen", 1, "assistant", "é🙂"),
    (None, "chosen", 0, "system", "s"), (None, "rejected", 0, "user", "s"),
    (5, "chosen", 1, "user", "b"), (5, "chosen", 1, "assistant", "a"), (5, "rejected", 1, "assistant", "a"),
    (6, "chosen", 0, "user", "x"), (6, "chosen", 1, "user", "y"), (6, "rejected", 0, "user", "x"),
]


def test_hard_cases(spark):
    frame = spark.createDataFrame(
        [(*r, 0, "z") for r in CASES], "pair_id long, side string, turn long, role string, text string, pos int, part string"
    )
    got = sorted((tuple(r) for r in preferences.format_preferences(frame).collect()), key=str)
    assert got == by_hand(CASES)
    assert preferences.format_preferences(frame.limit(0)).collect() == []


def test_masks_cover_assistant_text_only(spark):
    for r in queries.op6_preferences(spark, "/root/testdata/sf0.001").collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for span in filter(None, mask.split(",")):
                start, length = map(int, span.split(":"))
                assert text[:start].endswith("<|assistant|>\n") and text[start : start + length].endswith("<|end|>")


def test_plan_has_no_python(spark):
    plan = queries.op6_preferences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
