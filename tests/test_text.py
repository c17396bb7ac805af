from pyspark.sql import functions as F

from sparklex.functions import arrow
from sparklex.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_normal_forms(spark):
    assert one(spark, T.norm("a"), a="  a   b\tc\n") == "a b c"
    assert one(spark, T.norm("a"), a="a  b") == "a b"
    assert one(spark, T.norm("a"), a=None) == ""
    assert one(spark, T.fold_key("a"), a=" STRASSE  Straße") == "strasse strasse"
    assert one(spark, T.tokens("a"), a="   ") == []
    assert one(spark, T.strip_punct("a"), a="„kniha“,") == "kniha"


def test_predicates(spark):
    ok = lambda s: one(spark, T.length_ok("a"), a=s)
    assert ok("a b c") and not ok("a b") and not ok("") and not ok(" ".join("x" * 41))
    assert one(spark, T.is_word("a"), a="žona") and not one(spark, T.is_word("a"), a="a1")
    assert one(spark, T.is_salient("a"), a="kniha") and not one(spark, T.is_salient("a"), a="hišće")
    assert one(spark, T.is_quoted("a", "b"), a="woda", b='to je "woda" a') and not one(spark, T.is_quoted("a", "b"), a="woda", b="to je woda")


def test_extractors(spark):
    assert one(spark, T.mt_translation("a", "hsb"), a="<think>x\ny</think><hsb> hallo swět </hsb>") == "hallo swět"
    assert one(spark, T.mt_translation("a", "hsb"), a="<hsb> hallo") == "hallo"
    assert one(spark, T.mt_translation("a", "hsb"), a=" bare ") == "bare"
    both = "<wrong> a </wrong> <corrected> b </corrected>"
    assert one(spark, T.wrong_word("a"), a=both) == "a" and one(spark, T.corrected_word("a"), a=both) == "b"
    assert one(spark, T.wrong_word("a"), a=None) == ""
    lines = "<wrong>a\nb</wrong> <corrected>c\nd</corrected> <answer>1\n2</answer>"
    assert one(spark, T.wrong_word("a"), a=lines) == one(spark, T.corrected_word("a"), a=lines) == "" and one(spark, T.mr_answer("a"), a=lines) == "1\n2"
    assert one(spark, T.unquoted("a"), a=' ""Ta "sada" je"" ') == 'Ta "sada" je' and one(spark, T.unquoted("a"), a=None) == ""
    assert one(spark, T.mr_answer("a"), a="<think>t</think> x <answer> 18 </answer>") == "18"
    assert one(spark, T.first_number("a"), a="The answer is 3.") == 3
    assert one(spark, T.first_number("a"), a="none") == -1
    assert one(spark, T.first_number("a"), a="9" * 30) == -1


def test_gaps(spark):
    assert one(spark, T.target_gap("a"), a="Wupjelń městno čo. IV z prawym słowom") == "IV"
    assert one(spark, T.target_gap("a"), a="place II, please") == "II"
    assert one(spark, T.target_gap("a"), a="none") is None
    assert one(spark, T.gaps("a"), a="x ( I ) y (II)") == ["I", "II"]
    assert one(spark, T.fill_gap("a", "b", "c"), a="kak móžu ( I ) dźakować ( II ) hišće", b="I", c="wam") == "kak móžu wam dźakować hišće"


def test_answers(spark):
    fmt = lambda a, t: one(spark, T.postformat("a", "b"), a=a, b=t)
    assert fmt("\\frac{\\pi}{3}", "medium") == "$\\frac{\\pi}{3}$"
    assert fmt("42", "medium") == "42" and fmt("\\pi", "low") == "\\pi" and fmt("$\\pi$", "medium") == "$\\pi$" and fmt(None, "medium") == ""
    safe = lambda a: one(spark, T.answer_is_safe("a"), a=a)
    assert safe("1,234") and safe("3/4") and safe("[0, \\infty)") and not safe("") and not safe(None)
    assert not safe("this is a long prose answer")
    assert one(spark, T.is_degenerate("a", "b"), a="STRASSE", b="Straße") and one(spark, T.is_degenerate("a", "b"), a=" ", b="x")
    assert one(spark, T.gsm_answer("a"), a="x <<1+1=2>>\n#### 70,000") == "70000"
    assert one(spark, T.gsm_answer("a"), a="no mark") is None
    assert one(spark, T.gsm_rationale("a"), a="He has <<1+1=2>>2.\n#### 2") == "He has 2."
    assert arrow.last_boxed("a \\boxed{1} b \\boxed{\\frac{1}{2}}") == "\\frac{1}{2}"
    assert arrow.last_boxed("\\boxed{1") is None and arrow.last_boxed(None) is None


def test_words(spark):
    d = one(spark, T.suffix_delta("a", "b"), a="knihu", b="kniha")
    assert (d["stem"], d["removed"], d["added"]) == ("knih", "u", "a")
    d = one(spark, T.suffix_delta("a", "b"), a="", b="x")
    assert (d["stem"], d["added"]) == ("", "x")
    n = one(spark, T.neighbours("a", "b"), a="To je Dobra, kniha.", b="dobra")
    assert (n["left"], n["right"]) == ("je", "kniha")
    assert one(spark, T.replace_token("a", F.lit(1), "b", "c"), a="to „wona“ je", b="wona", c="wón") == "to „wón“ je"
    assert one(spark, T.replace_first("a", "b", "c"), a="aba ab", b="ab", c="X") == "Xa ab"
    assert one(spark, T.replace_first("a", "b", "c"), a="abc", b="z", c="X") == "abc"


def test_prompts(spark):
    df = spark.createDataFrame([("ctx", "q?", {"10": "j", "2": "b", "1": "a"}), (None, "q?", {})], "c string, q string, o map<string,string>")
    got = [r["x"] for r in df.select(T.format_options("o").alias("x")).collect()]
    assert got == ["1. a\n2. b\n10. j", ""]
    assert df.select(T.qa_prompt("c", "q", "o").alias("x")).first()["x"].endswith("ctx\nQuestion: q?\n1. a\n2. b\n10. j\nAnswer:")
    assert one(spark, T.mt_prompt("a", "German", "Lower Sorbian"), a="Haus") == "Translate the source text from German to Lower Sorbian\n\nGerman: Haus\nLower Sorbian:"
    chat = spark.range(1).select(T.render_mr(F.lit("q"), F.lit("3"), F.lit(" s ")).alias("m")).first()["m"]
    assert chat[1]["content"] == "s\n<answer> 3 </answer>" and chat[0]["role"] == "user"
    assert spark.range(1).select(T.render_mr(F.lit("q"), F.lit("3")).alias("m")).first()["m"][1]["content"] == "<answer> 3 </answer>"
    assert spark.range(1).select(T.valid_option(F.lit(7), F.create_map(F.lit("1"), F.lit("a"))).alias("x")).first()["x"] == 1
