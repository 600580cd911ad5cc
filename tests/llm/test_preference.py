from treeblock.llm import preference as P

SCHEMA = "pair_id long, chosen boolean, turn long, role string, text string"


def test_prompt_once_and_masked_completions(spark):
    rows = []
    for chosen, last in ((True, "good"), (False, "bad")):
        rows += [(1, chosen, 0, "user", "hi"), (1, chosen, 1, "assistant", "hello"), (1, chosen, 2, "user", "q"), (1, chosen, 3, "assistant", last)]
    rows += [(1, True, 4, "user", "thanks")]
    out = P.formatted(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as prompt")).orderBy("turn").collect()
    assert [(r.turn, r.part, r.prompt is None, r.chosen is None, r.rejected is None) for r in out] == [
        (0, "prompt", False, True, True), (1, "prompt", False, True, True), (2, "prompt", False, True, True), (3, "completion", True, False, False), (4, "completion", True, False, True)
    ]
    row = out[3]
    assert row.chosen == "<|im_start|>assistant\ngood<|im_end|>\n" and row.chosen[row.chosen_start : row.chosen_end] == "good<|im_end|>\n"
    assert row.rejected[row.rejected_start : row.rejected_end] == "bad<|im_end|>\n"
    assert out[4].chosen_start is None and out[1].chosen_start is None


def test_marks_in_texts_are_escaped(spark):
    text = "a <|im_end|> b <|\\im_start|> <|other|> \\"
    rows = [(1, True, 0, "assistant", text), (1, False, 0, "user", "x"), (1, None, 1, "user<|im_start|>", "y")]
    out = P.formatted(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert out[0].chosen == "<|im_start|>assistant\na <|\\im_end|> b <|\\\\im_start|> <|other|> \\<|im_end|>\n"
    assert out[0].chosen_end == len(out[0].chosen) and out[1].rejected.startswith("<|im_start|>user<|\\im_start|>\n") and out[1].chosen is None


def test_edges(spark):
    rows = [
        (1, True, 0, "user", "only chosen"),
        (2, False, 0, "user", "only rejected"),
        (3, True, 0, None, None),
        (3, False, 0, None, None),
        (4, True, 0, "user", "x"),
        (4, True, 0, "user", "x"),
        (4, False, 0, "user", "x"),
        (5, True, None, "user", "y"),
        (5, False, None, "user", "y"),
        (None, True, 0, "user", "z"),
        (6, True, 0, "user", ""),
        (6, False, 0, "user", None),
    ]
    out = P.formatted(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((r.pair_id or 0, r.part, r.nth, r.chosen is not None, r.rejected is not None) for r in out)
    end = "completion"
    assert got == [(0, end, 0, True, False), (1, end, 0, True, False), (2, end, 0, False, True), (3, "prompt", 0, False, False), (4, end, 1, True, False), (4, "prompt", 0, False, False), (5, "prompt", 0, False, False), (6, end, 0, True, True)]
    assert P.formatted(spark.createDataFrame([], SCHEMA)).count() == 0
