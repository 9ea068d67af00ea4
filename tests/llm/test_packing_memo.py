"""What the packing's encoder asks of the tokenizer, and what it keeps."""

from tokenizers import Tokenizer

from tabloom.llm import packing
from tabloom.llm.queries import tokenizer_path


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.calls = tokenizer, tokenizer.model, 0

    def encode(self, *args, **options):
        self.calls += 1
        return self.tokenizer.encode(*args, **options)


def test_plain_and_latin_words_need_no_whole_call():
    encode = packing.Encoder(tokenizer_path())
    encode.memo.tokenizer = plain = Counted(encode.memo.tokenizer)
    text = "The re-run, it's 3.14 (Größe) Ça déjà; ÑANDÚ''s x'll.'s &&&a%%% don't 'tis 1st a_b @home ÿß ''' $5,000.00"
    assert encode(text.encode(), 2).tolist() == [*plain.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert plain.calls == 0


def test_ids_of_awkward_characters_are_the_tokenizers():
    plain, encode = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    for c in [*range(1, 0x700), *range(0x1E00, 0x2200), 0xFB01, 0xFF21, 0x1F600]:
        for text in (chr(c), f"Ab{chr(c)}", f"{chr(c)}'s.{chr(c)}", f"é{chr(c)}1 É,{chr(c)}"):
            assert encode(text.encode(), 2).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], repr(text)


def test_memo_is_bounded_and_keeps_words_in_use(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 1_000)
    plain, encode = Tokenizer.from_file(tokenizer_path()), packing.Encoder(tokenizer_path())
    for i in range(60):
        text = "often " + " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + i % 26)}{i}" for j in range(100))
        assert encode(text.encode(), 2).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert len(encode.memo) + len(encode.memo.older) < 3_000
    assert b"often" in encode.memo or b"often" in encode.memo.older
