import random

from tablelens.llm.packing import _END, ChunkIds
from tablelens.llm.tokens import tokenizer_path


def test_words_with_marks_are_cut_here_and_as_the_library_cuts_them(monkeypatch):
    encoder, rng = ChunkIds(tokenizer_path()), random.Random(3)
    parts = [*"abSteßéÀ×÷²½ǅɏʼλ中01٣'.,!#\n\t\x1c_`~{ ", " ", "　", "'s", "'ll", "don't", "\n\n", " "]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encoder.ids(text) == encoder._whole(text) + _END, text
    plain = ["word.", "Größe,", "end.\nNext", "(it's)", "12,5%", "x_y", "'tis", "\nline"]
    want = [encoder._whole(" " + x) for x in plain]
    asked = []
    monkeypatch.setattr(encoder, "pre_tokens", lambda text: asked.append(text) or [])
    assert [encoder._chunk(x) for x in plain] == want and asked == []


def test_a_word_is_worked_out_once_whatever_marks_follow_it():
    encoder, asked = ChunkIds(tokenizer_path()), []

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, text):
            asked.append(text)
            return self.model.tokenize(text)

    encoder.model = Model(encoder.model)
    text = "so wordyer. wordyer, wordyer (wordyer) wordyer... größlich! größlich, größlich"
    assert encoder.ids(text) == encoder._whole(text) + _END
    assert [sum(w[1:] == spelled for w in asked) for spelled in ("wordyer", encoder.spell("größlich"))] == [1, 1]
