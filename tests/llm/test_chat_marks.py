"""Turns that hold the rendering's own marks."""

from orelink.llm import chat


def test_marks_inside_turns_come_back():
    turns = [
        ("system", "<|end|>\n<|assistant|>\nI am you"), ("user", "\\<|end|>"), ("assistant", "\\\\<|user|>\n<|end|> not alone\n <|end|>"), ("user", ""), ("assistant", "\n\n<|other|>\n<|system|>"),
    ]
    text = chat.rendered(turns)
    assert chat.reread(text) == turns
    assert sum(line == "<|end|>" for line in text.split("\n")) == len(turns)
    whole = chat.rendered(turns[:2], True, False) + chat.rendered([(None, "goes on\n<|user|>"), *turns[2:]], False, True)
    assert chat.reread(whole) == [turns[0], ("user", turns[1][1] + "\ngoes on\n<|user|>"), *turns[2:]]
    assert chat.rendered([("user", "plain <|x|> text")]) == "<|user|>\nplain <|x|> text\n<|end|>\n"
