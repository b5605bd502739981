import random

import public_tokenizers
import sentencepiece

from shardflow.llm.token_counts import Counter

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "   a   b   ", "\n", "a\nb", " \n ", "▁", "a▁ b", "x\ty", "日本語 テスト", "🙂 🙂🙂", "<s> </s> <unk> <0x0A>", "hello" * 400, "\x00 a", "é́", "the of and", "\r\n\r\n", " " * 33 + "x"]


def test_as_the_library():
    library, own, draw = sentencepiece.SentencePieceProcessor(model_file=PATH), Counter(PATH), random.Random(5)
    made = ["".join(draw.choice("abthe rn  \n\té'1.,日▁") for _ in range(draw.randrange(80))) for _ in range(5000)]
    for text in ODD + made:
        assert own.count(text) == len(library.encode(text)), repr(text)


def test_whole_tokens_are_one_token():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), Counter(PATH)
    for piece in random.Random(2).sample(sorted(x for x in own.whole if x[0] == "▁" and len(x) > 1), 2000):
        assert len(library.encode(piece[1:].replace("▁", " "))) == 1


def test_bounded_cache():
    own = Counter(PATH, keep=20)
    for i in range(200):
        own.count(f"zq{i}xx yy")
    assert len(own.known) <= len(own.whole) + 22
