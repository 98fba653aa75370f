import pytest
from pyspark.sql import functions as F

from quillspan.functions.analysis import Language, English, Plain, drop_stopwords, language, normalize, word_pairs
from quillspan.functions.excerpt import best_location, hit_positions, make_excerpt
from quillspan.functions.porter2 import stem
from quillspan.plans.query import Query
from quillspan.plans.schema import IndexSchema


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


def test_tokens_and_positions(spark):
    text = F.lit("three blind mices.")
    for lang in (Plain(), English()):
        assert list(one(spark, lang.tokenize(text))) == ["three", "blind", "mices"]
        assert list(one(spark, lang.positions(text))) == [0, 6, 12]
    assert list(one(spark, English().tokenize(F.lit("don't flip-flops")))) == ["don't", "flip", "flops"]
    assert list(one(spark, Plain().tokenize(F.lit("don't")))) == ["don", "t"]
    assert one(spark, Plain().positions(F.lit(""))) == []
    assert one(spark, normalize(F.lit(" a \t\n b "))) == "a b" and one(spark, normalize(F.lit(None).cast("string"))) == ""


def test_pairs_and_stop_words(spark):
    tokens = English().tokenize(F.lit("brush your teeth"))
    assert one(spark, word_pairs(tokens)) == ["brush your", "your teeth"]
    assert one(spark, word_pairs(F.array(F.lit("a")))) == [] and one(spark, word_pairs(F.array().cast("array<string>"))) == []
    assert one(spark, drop_stopwords(tokens, tokens, English.stoplist)) == ["brush", "teeth"]
    its = F.array(F.lit("it's"), F.lit("dog's"))
    assert one(spark, drop_stopwords(English().stem_tokens(its), its, English.stoplist)) == ["dog"]
    assert len(English.stoplist) == 98


def test_own_tokenizer_and_stemmer(spark):
    lang = Plain().set_tokenizer(lambda c: F.split(c, ":")).set_stemmer(lambda w: w[:2])
    tokens = lang.tokenize(F.lit("three:blind:mice"))
    assert one(spark, tokens) == ["three", "blind", "mice"]
    assert one(spark, lang.stem_tokens(tokens)) == ["th", "bl", "mi"]
    for bad in (Plain().set_tokenizer, Plain().set_stemmer):
        with pytest.raises(ValueError):
            bad("no function")


def test_languages():
    with pytest.raises(TypeError):
        Language()
    with pytest.raises(ValueError):
        language("Xx")
    assert language("Hr").stem_word("riba") == "riba"


@pytest.mark.parametrize(
    ("word", "root"),
    [("horse", "hors"), ("horses", "hors"), ("horsing", "hors"), ("flops", "flop"), ("mices", "mice"), ("running", "run"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("kiwis", "kiwi"), ("hoping", "hope"), ("hopping", "hop"), ("luxuriated", "luxuri"), ("relational", "relat"), ("generously", "generous"), ("communism", "communism"), ("adjustment", "adjust"), ("sky", "sky"), ("dying", "die"), ("happy", "happi"), ("enjoy", "enjoy"), ("controlling", "control"), ("at", "at"), ("proceed", "proceed"), ("electricity", "electr"), ("national", "nation")],
)
def test_stems(word, root):
    assert stem(word) == root


def test_excerpts():
    def cut(text, words, **more):
        lang = Plain()
        import re

        return make_excerpt(text, hit_positions(text, re.compile(lang.token_pattern), lambda w: w in words), lang.token_pattern, **more)

    assert cut("x a b c", {"a"}) == "x <strong>a</strong> b ..."
    assert cut("x a", {"a"}) == "x <strong>a</strong>"
    assert cut("", {"a"}) == ""
    long = "Some words come first here. " * 20 + "Then the needle is in this sentence. " + "More words follow it. " * 20
    got = cut(long, {"needle"}, length=60)
    assert "<strong>needle</strong>" in got and len(got) < 120
    assert best_location([5, 300, 310, 320], 150) == 310 and best_location([], 150) == 0
    assert "<" not in cut(long, {"needle"}, open_tag="")


def test_schema_errors():
    s = IndexSchema().define_field("body")
    assert (s.fields["body"].store, s.fields["body"].score, s.fields["body"].weight, s.fields["body"].tokenize) == (True, True, 1.0, False)
    for bad in ("body", "doc_id", "score", "a b", "x1", ""):
        with pytest.raises(ValueError):
            s.define_field(bad)
    with pytest.raises(ValueError):
        s.define_field("other", colour=1)
    s.frozen = True
    with pytest.raises(ValueError):
        s.define_field("late")
    with pytest.raises(ValueError):
        Query("x", any_or_all="some")
    with pytest.raises(TypeError):
        Query("x", colour=1)
