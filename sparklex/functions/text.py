"""Column functions on text: normal forms, tokens, predicates, extractors, prompts. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from both ends of a token, and quotation marks that protect a word.
STRIP = ".,!?;:\"'()„“»«–—"
QUOTES = ("'", '"', "„", "“", "»", "«")
#: All Unicode white space, written as a class both Java and RE2 read.
SPACE = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
CORRECT = "CORRECT"

# Names of the languages in prompts.
LANGUAGE = {"de": "German", "hsb": "Upper Sorbian", "dsb": "Lower Sorbian"}

# Instructions of the task prompts.
SC_INSTRUCTION = "The following sentence contains at most one misspelled word. Respond with exactly these two tags and nothing else:\n<wrong> misspelled word </wrong> <corrected> correct spelling </corrected>\nIf the sentence has no error, use the literal string CORRECT in both tags:\n<wrong> CORRECT </wrong> <corrected> CORRECT </corrected>"
GC_INSTRUCTION = "The following sentence contains at most one grammatically incorrect word. Respond with exactly these two tags and nothing else:\n<wrong> incorrect word </wrong> <corrected> correct form </corrected>\nIf the sentence has no error, use the literal string CORRECT in both tags:\n<wrong> CORRECT </wrong> <corrected> CORRECT </corrected>"
MR_INSTRUCTION = "Answer this mathematical reasoning question. Place your final answer, using LaTeX when appropriate, in this format: <answer> answer </answer>"
QA_INSTRUCTION = "Answer the multiple-choice question with the number of the correct option only."

# Function words that a cloze never masks.
STOPWORDS = ("a", "w", "z", "so", "je", "ja", "ty", "wón", "wona", "wono", "my", "wy", "woni", "to", "ta", "tón", "ale", "pak", "haj", "ně", "nic", "tule", "tu", "tam", "su", "bu", "zo", "na", "po", "při", "wot", "do", "ze", "přez", "za", "pod", "nad", "před", "mjez", "ma", "mam", "maš", "maja", "how", "tež", "hišće", "hač", "abo", "ga", "ten")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm(x) -> Column:
    """White space collapsed and trimmed; null as the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(_c(x).cast("string"), F.lit("")), f"{SPACE}+", " "))


def fold_key(x) -> Column:
    """The normal form without letter case, ß as ss."""
    return F.replace(F.lower(norm(x)), F.lit("ß"), F.lit("ss"))


def tokens(x) -> Column:
    """The tokens between white space; an empty text has none."""
    return F.filter(F.split(norm(x), " "), lambda t: t != "")


def token_count(x) -> Column:
    return F.size(tokens(x)).cast("long")


def length_ok(x, low: int = 3, high: int = 40) -> Column:
    return token_count(x).between(low, high)


def strip_punct(x) -> Column:
    return F.btrim(_c(x), F.lit(STRIP))


def is_word(x, least: int = 1) -> Column:
    """Letters only, `least` of them or more."""
    return _c(x).rlike("^\\p{L}+$") & (F.length(_c(x)) >= least)


def is_upper(x) -> Column:
    """The first character is a capital letter."""
    return F.coalesce(_c(x).rlike("^\\p{Lu}"), F.lit(False))


def is_salient(x) -> Column:
    return is_word(x, 4) & ~F.lower(_c(x)).isin(*STOPWORDS)


def is_quoted(word, sentence) -> Column:
    """A quotation mark stands right before or behind the word somewhere in the sentence."""
    w, s = _c(word), _c(sentence)
    found = F.lit(False)
    for q in QUOTES:
        found = found | (F.instr(s, F.concat(F.lit(q), w)) > 0) | (F.instr(s, F.concat(w, F.lit(q))) > 0)
    return found


# Extractors


def strip_thinking(x) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_c(x), F.lit("")), "(?s)<think>.*?</think>", ""))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")


def mt_translation(x, tag: str) -> Column:
    """What stands in the language's tag (the closing tag may be missing), else the whole text."""
    text = strip_thinking(x)
    return _trim(F.when(F.instr(text, f"<{tag}>") > 0, F.regexp_extract(text, f"(?s)<{tag}>(.*?)(?:</{tag}>|$)", 1)).otherwise(text))


def tagged(x, tag: str, lines: bool = False) -> Column:
    """Content of the first such tag, trimmed; empty without one. Only with `lines` may it go over line ends."""
    inside = "(?s:.)" if lines else "[^\\n]"
    return _trim(F.regexp_extract(strip_thinking(x), f"<{tag}>({inside}*?)</{tag}>", 1))


def wrong_word(x) -> Column:
    return tagged(x, "wrong")


def corrected_word(x) -> Column:
    return tagged(x, "corrected")


def mr_answer(x) -> Column:
    return tagged(x, "answer", lines=True)


def first_number(x) -> Column:
    """The first whole number of the text, -1 without one."""
    return F.coalesce(F.regexp_extract(F.coalesce(_c(x), F.lit("")), "(-?\\d+)", 1).try_cast("int"), F.lit(-1))


def valid_option(pred, options: Column) -> Column:
    """The number of an option if there is one of that number, else 1."""
    p = _c(pred)
    return F.when(p.between(1, F.size(options)), p).otherwise(F.lit(1)).cast("int")


GAP = "\\(\\s*([IVXLC]+)\\s*\\)"


def target_gap(question) -> Column:
    """The Roman numeral asked for: the one behind co./čo, else the first that stands alone; null without one."""
    q = F.coalesce(_c(question), F.lit(""))
    near = F.regexp_extract(q, "[čc]o\\.?\\s*([IVXLC]+)\\b", 1)
    return F.nullif(F.when(near != "", near).otherwise(F.regexp_extract(q, "\\b([IVXLC]+)\\b", 1)), F.lit(""))


def gaps(context) -> Column:
    """All gap numerals of the context in order."""
    return F.regexp_extract_all(F.coalesce(_c(context), F.lit("")), F.lit(GAP), 1)


def fill_gap(context, gap, option) -> Column:
    """The context with the option in the gap, other gap marks removed and blanks collapsed."""
    mark = "\x01"
    own = F.regexp_replace(F.coalesce(_c(context), F.lit("")), F.concat(F.lit("\\(\\s*"), F.coalesce(_c(gap), F.lit("-")), F.lit("\\s*\\)")), F.lit(mark))
    return _trim(F.regexp_replace(F.replace(F.regexp_replace(own, GAP, ""), F.lit(mark), F.coalesce(_c(option), F.lit(""))), "\\s{2,}", " "))


# Answers


def tier_of(item_id) -> Column:
    return F.when(F.coalesce(_c(item_id), F.lit("")).startswith("medium"), "medium").otherwise("low")


# What tells bare LaTeX, the characters of a formula, those that only a formula has, and its longest length.
LATEX = "\\\\frac|\\\\sqrt|\\\\pi|\\\\geq|\\\\leq|\\\\cdot|\\\\times|[\\[(].*,.*[\\])]"
FORMULA = "[0-9A-Za-z\\\\{}\\[\\]()+\\-*/.,;:=<>^_|!~ \\t°πφ√∞∪∩×÷±$]+"
FORMULA_ONLY = "[\\\\{}\\[\\]()/^_=+<>|πφ√∞∪∩×÷±°]"
PLAIN_NUMBER, PLAIN_FRACTION = "-?\\d[\\d,]*(\\.\\d+)?", "-?\\d+\\s*/\\s*-?\\d+"
FORMULA_LENGTH, PROSE_WORDS = 120, 4


def postformat(answer, tier) -> Column:
    """Bare LaTeX of the medium tier in dollar signs; all else as it is, trimmed."""
    a = _trim(F.coalesce(_c(answer), F.lit("")))
    bare = a.rlike(LATEX) & ~(a.startswith("$") & a.endswith("$"))
    return F.when((a != "") & (_c(tier) == "medium") & bare, F.concat(F.lit("$"), a, F.lit("$"))).otherwise(a)


def answer_is_safe(answer) -> Column:
    """Whether an answer can be compared as a string: a plain number or fraction, or a short text of a formula's characters
    that either has a sign of its own or too few words to be prose."""
    a = _trim(F.coalesce(_c(answer), F.lit("")))
    words = F.size(F.regexp_extract_all(a, F.lit("([A-Za-z]{2,})"), 1))
    unlike_prose = F.when(a.rlike(FORMULA_ONLY), F.lit(True)).otherwise(words < PROSE_WORDS)
    return F.when(a.rlike(f"^(?:{PLAIN_NUMBER}|{PLAIN_FRACTION})$"), True).when(a == "", False).otherwise(a.rlike(f"^{FORMULA}$") & (F.length(a) <= FORMULA_LENGTH) & unlike_prose)


def unquoted(x) -> Column:
    """The text without outer blanks and then without outer double quotation marks."""
    return F.regexp_replace(_trim(F.coalesce(_c(x), F.lit(""))), '^"+|"+$', "")


def is_degenerate(out, source) -> Column:
    """Empty, or the source over again apart from case."""
    o, s = _trim(F.coalesce(_c(out), F.lit(""))), _trim(F.coalesce(_c(source), F.lit("")))
    same = F.replace(F.lower(o), F.lit("ß"), F.lit("ss")) == F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))
    return (o == "") | ((s != "") & same)


def gsm_answer(answer) -> Column:
    """The whole number behind #### without separators, else null."""
    raw = F.regexp_replace(F.regexp_extract(F.coalesce(_c(answer), F.lit("")), "(?m)####\\s*(.+?)\\s*$", 1), "[, ]", "")
    return F.when(raw.rlike("^-?\\d+$"), raw)


def gsm_rationale(answer) -> Column:
    """The solution without the line of the answer and without calculator marks."""
    body = _trim(F.regexp_replace(F.coalesce(_c(answer), F.lit("")), "(?m)####\\s*.+?\\s*$", ""))
    return _trim(F.regexp_replace(body, "<<[^>]*>>", ""))


# Words


def common_prefix(a, b) -> Column:
    """Length of the longest common prefix."""
    x, y = _c(a), _c(b)
    n = F.least(F.length(x), F.length(y))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i)))).otherwise(0)


def suffix_delta(a, b) -> Column:
    """(stem, removed, added): what b has after the common prefix in place of a's ending."""
    x, y, n = _c(a), _c(b), common_prefix(a, b)
    rest = lambda s: F.substring(s, n + 1, F.length(s))
    return F.struct(F.substring(x, F.lit(1), n).alias("stem"), rest(x).alias("removed"), rest(y).alias("added"))


def neighbours(sentence, word) -> Column:
    """(left, right) of the word's first place in the sentence, in small letters; both null without one."""
    low = F.transform(tokens(sentence), lambda t: F.lower(strip_punct(t)))
    at = F.array_position(low, F.lower(_c(word)))
    return F.struct(F.when(at > 1, F.get(low, at.cast("int") - 2)).alias("left"), F.when(at > 0, F.get(low, at.cast("int"))).alias("right"))


def replace_token(sentence, position, core, candidate) -> Column:
    """The sentence with the token at the position (from 0) changed: its core gives way, marks around it stay."""
    cand, word = _c(candidate), _c(core)
    put = lambda t: F.concat(F.substring(t, F.lit(1), F.instr(t, word) - 1), cand, F.substring(t, F.instr(t, word) + F.length(word), F.length(t)))
    return F.array_join(F.transform(tokens(sentence), lambda t, i: F.when(i == _c(position), put(t)).otherwise(t)), " ")


def replace_first(sentence, old, new) -> Column:
    """The sentence with the first place of the substring changed."""
    s, o = _c(sentence), _c(old)
    at = F.instr(s, o)
    return F.when((at > 0) & (F.length(o) > 0), F.concat(F.substring(s, F.lit(1), at - 1), _c(new), F.substring(s, at + F.length(o), F.length(s)))).otherwise(s)


# Prompts


def sorted_options(options) -> Column:
    """The options as (k, v), in the order of their numbers."""
    return F.array_sort(F.transform(F.map_entries(_c(options)), lambda e: F.struct(e["key"].try_cast("int").alias("k"), e["value"].alias("v"))))


def format_options(options, separator: str = ". ") -> Column:
    return F.array_join(F.transform(sorted_options(options), lambda e: F.concat(e["k"].cast("string"), F.lit(separator), e["v"])), "\n")


def mt_prompt(source, source_name, target_name, exemplars: Column | None = None) -> Column:
    """The translation prompt; exemplars is an array of (src, tgt)."""
    s, t = (F.lit(x) if isinstance(x, str) and x in LANGUAGE.values() else _c(x) for x in (source_name, target_name))
    line = lambda name, text: F.concat(name, F.lit(": "), text)
    shots = F.lit("") if exemplars is None else F.concat_ws("", F.transform(F.coalesce(exemplars, F.array()), lambda e: F.concat(line(s, e["src"]), F.lit("\n"), line(t, e["tgt"]), F.lit("\n"))))
    return F.concat(F.lit("Translate the source text from "), s, F.lit(" to "), t, F.lit("\n\n"), shots, line(s, _c(source)), F.lit("\n"), t, F.lit(":"))


def sc_gc_prompt(sentence, task: str) -> Column:
    return F.concat(F.lit(SC_INSTRUCTION if task == "sc" else GC_INSTRUCTION), F.lit("\n<sentence> "), _c(sentence), F.lit(" </sentence>"))


def mr_prompt(question) -> Column:
    return F.concat(F.lit(MR_INSTRUCTION + " "), _c(question))


def qa_prompt(context, question, options) -> Column:
    ctx = _trim(F.coalesce(_c(context), F.lit("")))
    return F.concat(F.lit(QA_INSTRUCTION + "\n\n"), F.when(ctx != "", F.concat(ctx, F.lit("\n"))).otherwise(""), F.lit("Question: "), _c(question), F.lit("\n"), format_options(options), F.lit("\nAnswer:"))


def chat(user: Column, assistant: Column) -> Column:
    """A conversation of one user and one assistant message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("user", user), message("assistant", assistant))


def render_sc_gc(sentence, wrong, corrected, task: str) -> Column:
    return chat(sc_gc_prompt(sentence, task), F.concat(F.lit("<wrong> "), _c(wrong), F.lit(" </wrong> <corrected> "), _c(corrected), F.lit(" </corrected>")))


def render_qa(context, question, options, answer_number) -> Column:
    """The training form of a question, which differs from the prompt's."""
    body = F.concat(F.coalesce(_c(context), F.lit("")), F.lit("\n\nQuestion:\n"), _c(question), F.lit("\n\nPossible answers:\n"), format_options(options, ": "), F.lit("\n\nAnswer:"))
    return chat(body, _c(answer_number).cast("string"))


def render_mr(question, answer, steps=None) -> Column:
    body = F.lit("") if steps is None else _trim(F.coalesce(_c(steps), F.lit("")))
    return chat(mr_prompt(question), F.regexp_replace(F.concat(body, F.lit("\n<answer> "), _c(answer), F.lit(" </answer>")), f"^{SPACE}+", ""))
