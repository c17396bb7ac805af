"""Problem 1: prompt and response pairs whose response is defective, with the type of the defect."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklex.llm.completeness import _TERMINATED, EndModel, broken_off, fit_end_model, in_hash_order, structure
from sparklex.llm.language import NEAR_TIE, Profiles, fit_profiles, is_placeholder
from sparklex.llm.text import fold, sentences, visible
from sparklex.runtime import bounded_sample

#: Rows, about, on which the language profiles, the model of sentence ends and the closing marks of replies are fitted.
FIT_ROWS = 12_000
#: Replies of the sample that the model of sentence ends is fitted on.
END_ROWS = 5_000
#: Letters from which a sentence's language is judged by itself; evidence by which shorter ones must speak for another language.
LONG, SHORT_MARGIN = 20, 0.6
#: Words of the shortest tile of a copy; share of a reply's words that tiles must cover.
TILE, COVERED = 4, 0.95

# Role names, apart from case and outer blanks.
USER_ROLES = frozenset(["user", "human", "prompter", "question", "customer", "client"])
ASSISTANT_ROLES = frozenset(["assistant", "model", "bot", "gpt", "ai", "answer", "chatbot", "agent", "assistent"])

# Names of languages in instructions (without case and accents).
LANGUAGE_NAMES = {
    "upper sorbian": "hsb", "obersorbisch": "hsb", "hornjoserbsce": "hsb", "hornjoserbscinje": "hsb", "gornoserbski": "hsb",
    "lower sorbian": "dsb", "niedersorbisch": "dsb", "delnjoserbsce": "dsb", "dolnoserbski": "dsb", "dolnoserbscinje": "dsb",
    "german": "de", "deutsch": "de", "nemsce": "de", "nimski": "de", "english": "en", "englisch": "en", "jendzelsce": "en", "engelski": "en",
    "czech": "cs", "tschechisch": "cs", "cesce": "cs", "polish": "pl", "polnisch": "pl", "polsce": "pl", "polski": "pl",
}
_ASKED = re.compile(r"\b(?:in|into|to|auf|ins?|nach|do|na)\s+(?:the\s+)?(" + "|".join(sorted(LANGUAGE_NAMES, key=len, reverse=True)) + r")\b")

# The refusal grammars: what denies, what is done, what it is done to (without case and accents).
_REFUSALS = {
    "en": (r"can'?t|can’t|cannot|can not|unable|not able|won'?t|won’t|will not|decline|refuse|not be right for me|not allowed|not permitted|must not|may not", r"help|assist|answer|translat|check|complet|process|respond|reply|comply|provide|correct|review|fulfil|do\b|carry out|work on|deal", r"requests?|tasks?|questions?|texts?|sentences?|translations?|prompts?|inputs?|passages?|th(?:is|at)\b|with it|such"),
    "de": (r"kann[^.]* nicht|darf[^.]* nicht|mochte[^.]* nicht|will[^.]* nicht|werde[^.]* nicht|lehne[^.]* ab\b|ablehnen|nicht in der lage|weigere|nicht moglich|verweiger", r"helf|ubersetz|erledig|pruf|beantwort|bearbeit|antwort|ausfuhr|unterstutz|korrigier|losen|weiterhelf|nachkommen", r"anfragen?|aufgaben?|bitten?|fragen?|satz\w*|texte?\w*|ubersetzung\w*|eingabe|dabei|damit|dies\w*|das\b"),
    "hsb": (r"njemoz\w*|njesmedz\w*|njechcu|njecham|njemoh\w*|zapowe\w*|wotpokaz\w*|mi dowolene njeje|njeje mi", r"pomha\w*|preloz\w*|wotmolw\w*|pruwowa\w*|sprawdzi\w*|spelni\w*|dokonc\w*|wobdzela\w*|wukona\w*|porjedz\w*|prekontrol\w*", r"sad\w*|nadawk\w*|prostw\w*|prasenj\w*|tekst\w*|prelozk\w*|napraswan\w*|tut\w*|to\b"),
    "dsb": (r"njamog\w*|njamoz\w*|njesmej\w*|njok\w*|zapowe\w*|wotpokaz\w*|njejo mi", r"pomaga\w*|pseloz\w*|wotegron\w*|pseglad\w*|psegled\w*|pspytowa\w*|spelni\w*|dokonc\w*|wobzel\w*|wugbas\w*|porez\w*", r"sad\w*|nadawk\w*|psosb\w*|psasanj\w*|psasan\w*|tekst\w*|pselozk\w*|napsasowan\w*|tos\b|to\b"),
    "cs": (r"nemoh\w*|nemuz\w*|nesmim\w*|odmit\w*|nejsem schop\w*|nelze", r"pomoc\w*|pomah\w*|preloz\w*|odpoved\w*|zkontrol\w*|splni\w*|dokonc\w*|zpracov\w*|vyridi\w*|opravi\w*", r"vet\w*|ukol\w*|prosb\w*|otazk\w*|text\w*|preklad\w*|pozadav\w*|zadost\w*|t[oue]to?\b"),
    "pl": (r"nie mog\w*|nie moze\w*|nie wolno|odmawi\w*|nie jestem w stanie|nie potrafi\w*", r"pomoc\w*|pomag\w*|przetlumacz\w*|odpowiedz\w*|sprawdz\w*|wykona\w*|dokoncz\w*|przetworz\w*|poprawi\w*|zrealizow\w*", r"zdani\w*|zadani\w*|prosb\w*|pytani\w*|tekst\w*|tlumaczen\w*|t[oeya]go?\b"),
}
_REFUSALS |= {
    "sk": (r"nemozem|nesmiem|odmietam|nie som schopn\w*|nedokazem", r"pomoc\w*|prelozi\w*|odpoved\w*|skontrol\w*|splni\w*|dokonc\w*|sprac\w*|opravi\w*", r"vet[uay]|uloh\w*|prosb\w*|otazk\w*|text\w*|preklad\w*|poziadav\w*|ziadost\w*|t[oue]to?\b"),
    "hr": (r"ne mogu|ne smijem|odbijam|nisam u mogucnosti", r"pomo[cz]\w*|prev[eo]\w*|odgovor\w*|provjer\w*|izvrsi\w*|dovrsi\w*|obradi\w*|ispravi\w*", r"recenic\w*|zadat\w*|molb\w*|pitanj\w*|tekst\w*|prijevod\w*|zahtjev\w*|ov[aou]\b|to\b"),
    "ru": (r"не могу|не имею возможности|отказываюсь|не в состоянии|не буду", r"помо\w*|перев\w*|ответ\w*|выполн\w*|обработ\w*|провер\w*|исправ\w*", r"запрос\w*|задани\w*|задач\w*|просьб\w*|вопрос\w*|текст\w*|предложени\w*|эт\w*"),
    "uk": (r"не можу|не маю змоги|відмовляюс\w*|не в змозі", r"допомог\w*|перекла\w*|відпов\w*|викона\w*|обро\w*|перевір\w*|виправ\w*", r"запит\w*|завдан\w*|прохан\w*|питан\w*|текст\w*|речен\w*|ц[еію]\w*"),
    "nl": (r"kan[^.]* niet|mag[^.]* niet|niet in staat|weiger\w*", r"help\w*|vertal\w*|(?:be)?antwoord\w*|uitvoer\w*|verwerk\w*|controler\w*|verbeter\w*|voldoen", r"verzoek|taak|vraag|tekst|zin\b|vertaling|di?t\b|deze|hier(?:mee|bij)|daar(?:mee|bij)"),
    "sv": (r"kan inte|far inte|vagrar|inte mojligt|ar inte i stand", r"hjalp\w*|oversatt\w*|svara\w*|utfor\w*|behandl\w*|granska\w*|ratta\w*", r"begaran|uppgift\w*|frag\w*|text\w*|mening\w*|oversattning\w*|de(?:t|n)(?: har)?\b"),
    "fr": (r"ne p(?:eu|ui)[xs] pas|ne suis pas (?:en mesure|capable|autoris\w*)|ne pouvons pas|refuse|m['’]est impossible", r"aide\w*|tradui\w*|repond\w*|trait\w*|effectu\w*|corrig\w*|verifi\w*|complet\w*|satisfai\w*", r"demande|tache|question|texte|phrase|traduction|requete|ce(?:tte|la|ci)?\b"),
    "es": (r"no (?:puedo|podemos|soy capaz|me es posible|estoy autorizad\w*)|me niego|no poder", r"ayud\w*|tradu\w*|respond\w*|contest\w*|complet\w*|revis\w*|corregi\w*|procesar|cumplir|atender", r"solicitud|peticion|tarea|pregunta|texto|frase|oracion|traduccion|est[aeo]\b|es[ao]\b"),
    "it": (r"non (?:posso|possiamo|sono in grado|mi e possibile)|mi rifiuto", r"aiut\w*|tradu\w*|rispond\w*|complet\w*|elabor\w*|corregg\w*|verific\w*|soddisf\w*", r"richiesta|compito|domanda|testo|frase|traduzione|quest[oae]\b"),
    "pt": (r"nao (?:posso|consigo|sou capaz|me e possivel)|recuso", r"ajud\w*|traduz\w*|respond\w*|complet\w*|process\w*|corrig\w*|verific\w*|atender", r"pedido|tarefa|pergunta|texto|frase|traducao|solicitacao|iss?[ot]\b|est[ae]\b"),
}
_REFUSALS = {k: tuple(re.compile(rf"\b(?:{fold(x)})") for x in v) for k, v in _REFUSALS.items()}
_DENIES = re.compile("|".join(deny.pattern for deny, _, _ in _REFUSALS.values()))
# How apologies and courtesies begin that may stand beside a refusal (without case and accents).
_NEUTRAL = re.compile(r"\W*(?:i'?m (?:very |so |really )?sorry|i’m (?:very |so |really )?sorry|i am (?:very |so |really )?sorry|i apologi[sz]e|sorry\b|unfortunately\b|please\b|thank|es tut mir|tut mir|leider\W*$|entschuldig|verzeih|bitte\b|danke\b|bohuzel\W*$|wodaj|prosu\b|dzakuj|bozko\W*$|wodaj|pseps|pros(?:im|ze)\b|zekuj|omlouva|je mi lito|prepac|dekuj|przepraszam|przykro mi|niestety\W*$|dziekuj|prepacte|zial\b|oprostite|zao mi|nazalost|izvin|prosti|sozal|jammer|helaas|het spijt|tyvarr|forlat|desole|je suis desole|malheureusement|lo siento|lamento|lamentablemente|perdon|mi dispiace|purtroppo|spiacente|desculpe|sinto muito|infelizmente|" + fold("извин|прост|к сожалению|сожале|вибач|на жаль|перепрош") + r")")
# How verbs of asking for a text begin (without case and accents).
_VERBS = re.compile(r"\b(?:translat|render|answer|respond|reply|write|rewrit|express|put|say|give|continu|ubersetz|antwort|beantwort|schreib|gib|formulier|ubertrag|preloz|wotmolw|napis|pseloz|wotegron|odpove|odpowiedz|przetlumacz)")
_FIGURE = re.compile(r"\d+")
_NAME = re.compile(r"(?<=[^\W\d_] )[A-ZÄÖÜČĆĚŁŃÓŘŔŠŚŽŹ]\w{3,}")
_QUOTED = re.compile(r"[„“\"«»][^„“”\"«»]*[“”\"«»]")
_TAGS = re.compile(r"<[^<>]*>?")
_CLOSING = re.compile(r"</([A-Za-z][\w-]*)>\s*$")
_TOKENS = re.compile(r"\w+")
_LABEL_LINE = re.compile(r"^\s*[^\n:]{1,40}:\s*")
_SENTENCE_TAG = re.compile(r"<sentence>(.*?)</sentence>", re.S | re.I)
_OPTION = re.compile(r"^\s*\(?\d{1,2}[.):]\s+")


def role_of(role: str | None) -> str:
    """user, assistant or other; case, outer blanks and synonyms don't matter."""
    r = (role or "").strip().lower()
    return "user" if r in USER_ROLES else "assistant" if r in ASSISTANT_ROLES else "other"


def pairs_of(messages) -> list[tuple[int, str | None, str | None]]:
    """(pair_no, user text, reply): a user message and the next message if it is the assistant's.

    Further messages of the assistant before the next user message belong to the reply.
    """
    return _paired((m.get("role"), m.get("content")) for m in messages or [] if m is not None)


def _paired(turns) -> list[tuple[int, str | None, str | None]]:
    """pairs_of for (role, content)."""
    out: list[list] = []
    for role, content in turns:
        kind = role_of(role)
        if kind == "user":
            out.append([len(out) + 1, content, None])
        elif kind == "assistant" and out and content is not None:
            out[-1][2] = content if out[-1][2] is None else f"{out[-1][2]}\n{content}"
    return [tuple(p) for p in out]


def _turns(messages: pa.ListArray):
    """Yields the (role, content) of each row's messages."""
    roles, contents = (x.to_pylist() for x in messages.flatten().flatten())
    at = 0
    for n in messages.value_lengths().fill_null(0).to_pylist():
        yield zip(roles[at : at + n], contents[at : at + n])
        at += n


def is_refusal(text: str) -> bool:
    """Every sentence declines to work on the request, by one of the grammars, or is an apology, a courtesy or a mere mark
    beside one that declines."""
    if not _DENIES.search(fold(text)):
        return False
    declines = False
    for p in sentences(text):
        f = fold(p)
        if any(deny.search(f) and act.search(f) and thing.search(f) for deny, act, thing in _REFUSALS.values()):
            declines = True
        elif any(map(str.isalpha, f)) and not _NEUTRAL.match(f):
            return False
    return declines


def _marks(text: str) -> set[str]:
    """Figures and names: what a translation keeps of its source."""
    return set(_FIGURE.findall(text)) | set(_NAME.findall(text))


def declines(reply: str, given: str) -> bool:
    """The reply is a refusal and no translation of a text that itself speaks of refusing.

    It is a translation if it keeps all figures of the text, or if the text speaks of refusing and the reply keeps one of
    its figures and names (or there are none). What the reply quotes is not counted.
    """
    if not is_refusal(reply):
        return False
    own = _QUOTED.sub(" ", reply)
    figures = set(_FIGURE.findall(given))
    if figures and figures <= set(_FIGURE.findall(own)):
        return False
    speaks = any(deny.search(f) and act.search(f) for f in map(fold, sentences(given)) for deny, act, _ in _REFUSALS.values())
    return not (speaks and (not _marks(given) or _marks(given) & _marks(own)))


def tiled_share(reply: list[str], task: list[str], least: int = TILE) -> float:
    """Share of the reply's words in tiles of `least` words or more that also stand in the task (greedy string tiling)."""
    if not reply:
        return 0.0
    places = defaultdict(list)
    for i in range(len(task) - least + 1):
        places[tuple(task[i : i + least])].append(i)
    used_task, used = [False] * len(task), [False] * len(reply)
    while True:
        best, found = least - 1, []
        i = 0
        while i <= len(reply) - least:
            if not any(used[i : i + least]):
                for j in places.get(tuple(reply[i : i + least]), ()):
                    k = 0
                    while i + k < len(reply) and j + k < len(task) and reply[i + k] == task[j + k] and not used[i + k] and not used_task[j + k]:
                        k += 1
                    if k > best:
                        best, found = k, [(i, j)]
                    elif k == best and k >= least:
                        found.append((i, j))
            i += 1
        if not found:
            return sum(used) / len(reply)
        for i, j in found:
            if not any(used[i : i + best]) and not any(used_task[j : j + best]):
                used[i : i + best] = [True] * best
                used_task[j : j + best] = [True] * best


def gives_back(reply: str, task: str) -> bool:
    """The reply is nothing but words of the task, in tiles; a text given back twice counts as given back."""
    lines = [_TOKENS.findall(s.casefold()) for s in re.split(r"\n+", reply)]
    words = [w for x in lines for w in x]
    if len(words) < TILE:  # shorter than a tile: nothing but the whole text of the task
        return len(words) > 1 and not all(w[:1].isupper() or w.isdigit() for w in _TOKENS.findall(reply)) and words == _TOKENS.findall(task_text(task).casefold())
    source = _TOKENS.findall(task.casefold())
    known = set(source)
    if sum(w not in known for w in words) > (1 - COVERED) * len(words):  # no tile holds them
        return False
    quick = {tuple(source[i : i + TILE]) for i in range(len(source) - TILE + 1)}
    if sum(tuple(words[i : i + TILE]) in quick for i in range(len(words) - TILE + 1)) < 0.7 * (len(words) - TILE + 1) - 2:
        return False
    share = sum(tiled_share(x, source) * len(x) for x in lines) / len(words)
    if share < COVERED:
        half = len(words) // 2
        return len(words) % 2 == 0 and words[:half] == words[half:] and tiled_share(words[:half], source) >= COVERED
    return True


def task_text(user: str) -> str:
    """What the user message gives to work on: the tagged sentence, or its last line that isn't a mere label."""
    if m := _SENTENCE_TAG.findall(user):
        return m[-1].strip()
    lines = [x for x in user.split("\n") if x.strip()]
    while lines and re.fullmatch(r"\s*[^\n:]{1,40}:\s*", lines[-1]):
        lines.pop()
    return _LABEL_LINE.sub("", lines[-1]).strip() if lines else ""


def asked_language(user: str) -> str | None:
    """The language that the message asks for.

    The opening sentence counts; if it asks for none, so does every other sentence with a verb of asking, first those
    outside of the text that is given to work on. Of several languages in a sentence the last is meant.
    """
    opening = _ASKED.findall(fold(re.split(r"\n|(?<=[a-z])\.(?:\s|$)", user.strip(), maxsplit=1)[0]))
    if opening:
        return LANGUAGE_NAMES[opening[-1]]
    if not _ASKED.search(folded := fold(user)) or not _VERBS.search(folded):
        return None
    given, found = task_text(user), {}
    for p in sentences(_SENTENCE_TAG.sub(" ", user)):
        f = fold(p)
        names = _ASKED.findall(f)
        if names and (verb := _VERBS.search(f)):
            inside = p in given
            if not inside or verb.start() < 3:
                found[inside] = LANGUAGE_NAMES[names[-1]]
    return found.get(False, found.get(True))


class Judge:
    """All that is fitted on the sample, and the decision for a batch of pairs."""

    def __init__(self, profiles: Profiles, ends: EndModel, closings: dict[str, str]):
        self.profiles, self.ends, self.closings = profiles, ends, closings

    def before_language(self, task: str, user: str, reply: str | None) -> str | None:
        if reply is None or is_placeholder(reply) or not any(map(str.isalnum, _TAGS.sub(" ", reply))):
            return "empty"
        given = task_text(user)
        if declines(_TAGS.sub(" ", reply), given):
            return "refusal"
        st = structure(reply)
        if any(x.startswith("<") for x in st.open) or st.broken and not st.terminated:
            return "truncated"
        if gives_back(_TAGS.sub(" ", reply), user):
            return "copy"
        return None

    def after_language(self, task: str, kind: str, user: str, reply: str) -> str | None:
        closing = self.closings.get(task)
        if closing and not re.search(rf"</{re.escape(closing)}>", reply, re.I):
            return "truncated"
        if closing:
            return None
        body = _OPTION.sub("", reply)
        return "truncated" if broken_off(body, task_text(user) if kind else None, kind or task, self.ends) else None

    def judge(self, rows: list[tuple[str, str, str, str | None]]) -> list[str | None]:
        """rows: (task, direction, user text, reply)."""
        out = [self.before_language(t, u, r) for t, _, u, r in rows]
        check, spans, texts = [], [], []
        for i, (t, _, user, reply) in enumerate(rows):
            if out[i] is None:
                asked = asked_language(user)
                parts = [s for s in sentences(_TAGS.sub(" ", visible(_OPTION.sub("", reply)))) if any(map(str.isalpha, s))] if asked in self.profiles.languages else []
                check.append(i)
                spans.append((asked, len(texts), len(texts) + len(parts)))
                texts += parts
        cos, letters = self.profiles.cosines(texts)
        for i, (asked, a, b) in zip(check, spans):
            task, kind, user, reply = rows[i]
            if b > a and self.elsewhere(cos[a:b], letters[a:b], self.profiles.languages.index(asked), bool(_TERMINATED.search(_TAGS.sub(" ", reply)))):
                out[i] = "language"
                continue
            out[i] = self.after_language(task, kind, user, reply)
        return out

    @staticmethod
    def elsewhere(cos, letters, asked: int, terminated: bool) -> bool:
        """The sentences are wholly in another language than the one asked for.

        Each sentence of LONG letters or more must be nearer to another language. Shorter ones decide together, by their
        evidence, where there is no other; a lone sentence without a final mark needs a wider margin.
        """
        long = letters >= LONG
        if not long.any():
            evidence = (cos * (letters[:, None] ** 0.5)).sum(0)
            return bool(evidence.max() - evidence[asked] > (SHORT_MARGIN if terminated or len(cos) > 1 else 2 * SHORT_MARGIN))
        far = cos[long].max(1) - cos[long, asked]
        return bool((far > NEAR_TIE).all() and (long.sum() > 1 or terminated or far[0] > 2 * NEAR_TIE))


def fit_judge(rows: list[tuple[str, str, str | None, list]]) -> Judge:
    """rows: (task, direction, label, messages) of the sample."""
    texts, labels, ends, closings, replies = [], [], [], defaultdict(Counter), Counter()
    for task, direction, label, messages in rows:
        for _, user, reply in pairs_of(messages):
            if not reply or is_placeholder(reply):
                continue
            texts.append(reply)
            labels.append(label)
            replies[task] += 1
            if m := _CLOSING.search(reply):
                closings[task][m.group(1).lower()] += 1
            body = _OPTION.sub("", _TAGS.sub(" ", reply))
            ends.append((body, task_text(user or "") if direction else None, direction or task))
    # A closing tag that most replies of a task end with is what its replies must end with.
    most = {t: max(c.items(), key=lambda x: (x[1], x[0])) for t, c in closings.items()}
    must = {t: tag for t, (tag, n) in most.items() if n > 0.6 * replies[t]}
    return Judge(fit_profiles(texts, labels), fit_end_model(in_hash_order(ends)[:END_ROWS]), must)


def _runner(judge: Judge):
    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for row, task, direction, turns, by in zip(*(batch.column(i).to_pylist() for i in range(3)), _turns(batch.column(3)), batch.column(4).to_pylist()):
                for no, user, reply in _paired(turns):
                    keys.append((row, no, by))
                    rows.append((task or "", direction or "", user or "", reply))
            defects = judge.judge(rows)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array(defects, pa.string()), pa.array([k[2] for k in keys], pa.string())], ["row_id", "pair_no", "defect", "by"])

    return run


def judged_pairs(training: DataFrame, judge: Judge | None = None, by: str | None = None) -> DataFrame:
    """(row_id, pair_no, defect): every pair of every row, the defect null for a sound pair; with the column `by` if named.

    training has row_id, task, direction, lang and messages; other columns are not read. A null or empty list of messages
    has no pairs; a user message without a reply, or with a null one, is a pair with defect empty. Replies are judged
    whole. A repeated row_id gives the pairs of each of its rows.
    """
    chats = F.col("messages").cast("array<struct<role:string,content:string>>").alias("messages")
    rows = training.select(F.col("row_id").cast("long"), F.lower(F.trim("task")).alias("task"), F.col("direction"), chats, (F.col(by) if by else F.lit(None)).cast("string").alias("by"))
    if judge is None:
        sample = bounded_sample(training.select("row_id", F.lower(F.trim("task")).alias("task"), "direction", "lang", "messages"), "row_id", FIT_ROWS).collect()
        judge = fit_judge([(r["task"] or "", r["direction"] or "", r["lang"], [m.asDict() if m is not None else None for m in r["messages"] or []]) for r in sample])
    out = rows.mapInArrow(_runner(judge), "row_id long, pair_no int, defect string, by string")
    return out.withColumnRenamed("by", by) if by else out.drop("by")


def defective_pairs(training: DataFrame, judge: Judge | None = None) -> DataFrame:
    """(row_id, pair_no, defect) of the defective pairs."""
    return judged_pairs(training, judge).where("defect is not null")


