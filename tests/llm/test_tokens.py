import json
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quizmill.llm.tokens import END, Encoder, _byte_of_char, default_path, encoder, ranks_suffice


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", " \n ", "\t", "don't", "'ll", "<|endoftext|>", "été", "漢字", "a" * 300, "123456", "!!!", " ", "\x1c", "🙂"])), max_size=12).map("".join))
def test_both_encoders_agree(text):
    e = encoder(default_path())
    assert np.array_equal(e.batch(["", text])[1][:-1], library().encode(text, add_special_tokens=False).ids)


@cache
def library():
    return Tokenizer.from_file(default_path())


def test_both_split_alike_at_every_character():
    """Where words end depends on the class of each character alone: every one in front of, between and behind letters, digits, marks and spaces."""
    e, differ = encoder(default_path()), []
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        some = points[at : at + 4000]
        text = "".join(f"a{c}1{c}!{c} {c}{c}a" for c in map(chr, some))
        if not np.array_equal(e.fast.encode_to_numpy(text, disallowed_special=()), library().encode(text, add_special_tokens=False).ids):
            differ += [c for c in some if e.fast.encode(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}a", disallowed_special=()) != library().encode(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}a", add_special_tokens=False).ids]
    assert differ == []


def test_an_added_token_has_its_own_id():
    e = encoder(default_path())
    for text in ("hello <|endoftext|> x", "<|endoftext|>", "é<|endoftext|><|endoftext|>"):
        assert e.batch(["", text])[1].tolist() == [*library().encode(text, add_special_tokens=False).ids, END]
    assert 50256 in e.batch(["", "hello <|endoftext|> x"])[1]


def test_ids_depend_on_the_text_alone():
    """As a task that is tried again gives them: in another order, in another process, beside other texts."""
    texts = ["one text", None, "two <|endoftext|>", "été 漢字 123", "", "zz top"]
    a, b = Encoder(default_path()), Encoder(default_path())
    first = [x.tolist() for x in a.batch(texts)]
    assert [x.tolist() for x in b.batch(texts[::-1])][::-1] == first == [a.batch([t])[0].tolist() for t in texts]


def test_ranks_suffice_only_where_they_do(tmp_path):
    with open(default_path(), encoding="utf-8") as f:
        whole = json.load(f)
    assert ranks_suffice(default_path())

    def small(merges, ids=None, **more):
        chars = list(_byte_of_char())
        made = ["".join(m) for m in merges]
        vocab = {c: i for i, c in enumerate(chars)} | {t: 256 + (ids[k] if ids else k) for k, t in enumerate(made)}
        told = whole | {"added_tokens": [], "model": whole["model"] | {"vocab": vocab, "merges": merges} | more}
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(told))
        return str(path)

    assert ranks_suffice(small([["a", "b"], ["ab", "c"]]))
    # of falling ids, of a token that its own characters don't make, and with other settings
    bad = [small([["b", "c"], ["a", "b"]], ids=[1, 0]), small([["a", "b"], ["b", "c"], ["a", "bc"]]), small([["a", "b"]], continuing_subword_prefix="#")]
    for path in bad:
        assert not ranks_suffice(path) and Encoder(path).fast is None
    # where the least id would merge what the model doesn't
    assert Encoder(bad[1]).batch(["abc"])[0].tolist()[:-1] == Tokenizer.from_file(bad[1]).encode("abc", add_special_tokens=False).ids
