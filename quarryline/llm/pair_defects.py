"""Broken prompt and response pairs.

Method: a response is cut into clauses (sentences, list items, code blocks) and a linear-chain conditional random field
tags each as answer, refusal, echo, foreign or unfinished; the shares of the tags in the response decide the pair's
defect.  The field is trained here, on ``TRAINING_PAIRS`` labelled pairs made from the seed sentences below, by
stochastic gradient ascent on the conditional likelihood; the same pairs and the same weights come out every time.

Defined cases
-------------
* A null answer, and one of blanks, marks, an empty code block or a stand-in for a missing value, is ``empty``.
* A null or blank question can't be copied and has no language; the other defects are still told.
* An answer that is only code or a path is sound.  Very long texts are read whole.  A pair has at most one defect;
  the order is empty, refusal, copy, language, truncated.
* Repeated rows of one id give one row each defect.  Empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

import random
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import spread

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
#: The bound of the labelled training set, and passes over it.
TRAINING_PAIRS, EPOCHS = 700, 12

# -- languages -------------------------------------------------------------------------------------------------
_STOP = {
    "en": "the and to of is a an when for with that not it before are does do how which why what where show me i you on by as at be this from then only each every all its was has have if we or can there their they between after without please into twice should look my call",
    "de": "der die das den dem des und nicht wenn für ein eine einen einem ist von vom nach ob wie ich kann ohne dass mit auf aus bei wird hängt davon ab nur bis weil darum warum wo welche welcher wirft immer zweimal mehr steht zum zur im am sich er sie es war sind auch noch mir bitte gesagt kurz ja leider oder über bevor danach",
    "es": "el la los las y de del un una unos cuando que para si con sin se cómo qué dónde por pero pues hasta antes después está son más al en su lo le es como porque ya sí breve cada solo todavía luego puedo este esta más detalles",
}
_STOPS = {w: lang for lang, words in _STOP.items() for w in words.split()}
_AMBIGUOUS = {"es", "die", "a", "in", "no", "as", "me", "he", "son", "si", "so", "an", "was", "am", "des", "den", "le", "lo", "bei"}
_SPANS = re.compile(r"```[\s\S]*?(?:```|\Z)|`[^`\n]*`?")
_EDGES = ".,;:!?()[]{}<>\"'«»“”„…¿¡*-–—"


def _prose_words(text: str) -> list[str]:
    """The words of a text in lower case, without code spans, paths, numbers and identifiers."""
    out = []
    for token in (_SPANS.sub(" ", text) if "`" in text else text).split():
        core = token.strip(_EDGES)
        if not core or core[0].isdigit() or "_" in core or "." in core or "/" in core or "@" in core or "\\" in core:
            continue
        low = core.casefold()
        if core[1:] != low[1:] and not core.isupper():
            continue  # a capital inside: camel case
        out.append(low)
    return out


_CYRILLIC, _UMLAUT, _ACCENT = re.compile("[а-яё]"), re.compile("[äöüß]"), re.compile("[ñáíóú]")


def language(text: str) -> str | None:
    """ru, en, de or es, by script and function words; None where nothing tells."""
    words = _prose_words(text)
    if not words:
        return None
    joined = "".join(words)
    if len(_CYRILLIC.findall(joined)) > 0.35 * len(joined):
        return "ru"
    score = {"en": 0.0, "de": 0.0, "es": 0.0}
    for w in words:
        lang = _STOPS.get(w)
        if lang:
            score[lang] += 0.4 if w in _AMBIGUOUS else 1.0
    if not joined.isascii():
        score["de"] += sum(1.0 for w in words if _UMLAUT.search(w))
        score["es"] += sum(1.0 for w in words if _ACCENT.search(w))
    if "¿" in text or "¡" in text:
        score["es"] += 2.0
    best = max(score, key=score.__getitem__)
    rest = sorted(score.values())[-2]
    return best if score[best] > rest else None


_LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|английск\w*|inglés|ingles",
    "de": r"german|deutsch\w*|немецк\w*|alemán|aleman",
    "es": r"spanish|spanisch\w*|испанск\w*|español|espanol|castellano",
    "ru": r"russian|russisch\w*|русск\w*|ruso",
}
_ASKS = re.compile(
    r"(?:answer|reply|respond|response|write|explain|translate|ответ\w*|напиши\w*|отвеч\w*|перевед\w*|объясни\w*|antwort\w*|schreib\w*|responde\w*|respuesta|contesta\w*|escrib\w*|traduc\w*|in|на|auf|en)\b[^.?!\n]{0,40}?\b(?:" + "|".join(f"(?P<{k}>{v})" for k, v in _LANGUAGE_NAMES.items()) + r")\b",
    re.I,
)


def asked_languages(question: str) -> set[str]:
    """Languages the question asks the answer to be in."""
    low = question.casefold()
    if not any(x in low for x in ("engl", "англ", "ingl", "german", "deutsch", "немец", "alem", "span", "испан", "espa", "castell", "russ", "русск", "ruso")):
        return set()
    return {k for m in _ASKS.finditer(question) for k, v in m.groupdict().items() if v}


def question_language(question: str) -> str | None:
    """The language of most of the question's prose, by clause."""
    total: dict[str, int] = {}
    for clause in re.split(r"(?<=[.?!])\s+|\n", question):
        lang = language(clause)
        if lang:
            total[lang] = total.get(lang, 0) + len(clause) + (60 if "?" in clause else 0)
    return max(total, key=lambda k: (total[k], k)) if total else None


# -- clauses ---------------------------------------------------------------------------------------------------
_NOTHING = re.compile(r"(?:n[/.\\]?a\.?|none|null|nil|nan|undefined|empty|missing|unknown|void|no answer|no response|not available|tbd|todo|нет|нет ответа|нет данных|пусто|н/д|keine(?: antwort)?|leer|sin respuesta|vacío|ninguno?)", re.I)


_FOUR_WORDS = re.compile(r"\w{2,}\W+\w{2,}\W+\w{2,}\W+\w{2,}")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if _FOUR_WORDS.search(answer):
        return False
    text = re.sub(r"```[ \t]*\w*[ \t]*\r?\n?\s*(?:```|\Z)", " ", answer)
    text = "".join(c for c in text if unicodedata.category(c)[0] not in "CZ" or c == " ").strip()
    bare = "".join(c for c in text if unicodedata.category(c)[0] not in "PSM" or c == "/").strip(" /")
    return not bare or bool(_NOTHING.fullmatch(text.strip(" .!?()[]<>{}\"'`*_-—"))) or bool(_NOTHING.fullmatch(bare))


def clauses(answer: str) -> list[tuple[str, str]]:
    """(kind, text): kind is ``code``, ``open`` (a code block without its end), ``item`` or ``text``."""
    out: list[tuple[str, str]] = []
    at = 0
    for m in re.finditer(r"```[\s\S]*?(```|\Z)", answer):
        out += _prose(answer[at : m.start()])
        out.append(("code" if m.group(1) else "open", m.group()))
        at = m.end()
    return out + _prose(answer[at:])


_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])(?:\s+|$)")


def _prose(text: str) -> list[tuple[str, str]]:
    out = []
    for line in text.split("\n"):
        if not line.strip():
            continue
        kind = "item" if _ITEM.match(line) else "text"
        head = _ITEM.match(line).end() if kind == "item" else 0
        parts = re.split(r"(?<=[.!?…])\s+(?=\S)", line[head:].strip())
        parts[0] = line[:head] + parts[0]
        out += [(kind, p) for p in parts if p.strip()]
    return out


# -- features --------------------------------------------------------------------------------------------------
_NEGATIVE = re.compile(
    r"(?:can(?:no|['’])t|can not|could ?n['’]?o?t|unable|not able|not permitted|not allowed|not authori[sz]ed|won['’]t|will not|must not|rather not|do(?:es)? not have|don['’]t have|decline|refuse|no information|not enough (?:information|data|context)|insufficient|not (?:share|discuss|answer|help)|sorry, no)\b"
    r"|недостаточно (?:информации|данных|сведений)|не (?:могу|буду|можем|вправе|имею|разрешено|получится|располагаю|смогу|готов|стану|уполномочен)|нельзя|нет (?:доступа|информации|данных|права)|запрещено|отказываюсь"
    r"|\b(?:kann|darf|können|dürfen|werde|möchte)\b[^.]*\b(?:nicht|keine?n?)\b|\bkeine?n? (?:zugriff|auskunft|informationen|angaben)|\bnicht (?:erlaubt|gestattet|befugt|möglich)"
    r"|\bno (?:puedo|podemos|tengo|dispongo|voy|debo|me (?:está|es)|está permitido|quiero)|\bme niego",
    re.I,
)
_FIRST = re.compile(r"\b(?:i|i['’]m|i['’]d|i['’]ll|i['’]ve|we|this bot|the assistant|as an? (?:ai|assistant|bot|model)|my)\b|\b(?:я|мне|меня|мы|нам|мой|этот бот)\b|\b(?:ich|mir|mich|wir|uns)\b|\b(?:yo|me|mi|puedo|tengo|dispongo|voy|debo|siento|lamento)\b|\bне (?:могу|буду|смогу)\b", re.I)
_HELP = re.compile(
    r"\b(?:help|answer|assist|discuss|share|provide|comment|tell|say|access|disclose|talk|respond|reply|information|request|questions?|show|reveal)\b"
    r"|помо[чг]\w*|отве[тч]\w*|обсужд\w*|показ\w*|сообщ\w*|предостав\w*|информаци\w*|рассказ\w*|комментир\w*|раскры\w*|вопрос\w*|запрос\w*"
    r"|\b(?:helfen|beantwort\w*|antwort\w*|zugriff|auskunft|sagen|besprechen|teilen|informationen|zeigen|anfrage|weiterhelfen|kommentieren)\b"
    r"|\b(?:ayudar\w*|respond\w*|hablar|compartir|comentar|informaci[óo]n|mostrar|contestar|consulta|pregunta|solicitud|revelar)\b",
    re.I,
)
_APOLOGY = re.compile(r"sorry|unfortunately|apolog|regret|извин|сожалени|прости|leider|tut mir leid|entschuld|bedau|lo siento|lamento|disculp|desgracia|lamentablemente|perdon", re.I)
_SCOPE = re.compile(r"outside (?:of )?(?:what|my|the scope)|beyond (?:what|my|the scope)|(?:выход\w*|вне)[^.]{0,12}(?:рамк|предел|компетенц)|разрешено|außerhalb|fuera de(?:l| lo| mi)?|not something i", re.I)
_COURTESY = re.compile(
    r"^(?:please (?:rephrase|contact|ask|try|consult)|thanks? (?:you )?for (?:asking|your)|try (?:another|again)|contact the|ask the|пожалуйста, (?:переформулируйте|обратитесь|задайте|уточните)|переформулируйте|обратитесь|спасибо за|bitte (?:wenden|formulieren|fragen|stellen)|danke für|por favor,? (?:reformul|contact|consult|pregunt)|gracias por|hope|good question|is there anything|feel free)",
    re.I,
)
_QUOTE = re.compile(r"[\"“«„][^\"”»“]{4,}[\"”»“]")
_STAND = re.compile(r"`[^`]+`|\b\w+_\w+\b")
_GREETING = re.compile(r"^(?:sorry for the (?:wait|delay)|short answer: (?:yes|no)|good question|i looked at the graph|извините за (?:задержку|ожидание)|коротко: (?:да|нет)|kurz gesagt: (?:ja|nein)|entschuldig\w* (?:für|die) [^.]*(?:wart|verzöger)\w*|en breve: (?:sí|no)|perdón? por la (?:espera|demora)|disculp\w* la (?:espera|demora|tardanza)|hello|hi|hallo|hola|привет|sure|of course|конечно|gern|claro)[.!,:]*$", re.I)
_SOURCES = re.compile(r"^(?:sources?|see also|files?|references?|источники?|см\.?|файлы?|quellen?|dateien?|fuentes?|archivos?|véase)\s*:", re.I)
_PATH = re.compile(r"`?[\w./\\@:-]+\.[A-Za-z]\w{0,5}(?::\d+)?`?[,;]?$")
_COMPLETE = re.compile(r"[.!?…:;。][\"'”»)\]`*_]*$|[)\]}][.!?]?$|`[\"')]*$|\s[:;]-?[)D(P]$|[”»\"]$")
_PREFIX = re.compile(r"^\s*(?:>+\s*|(?:question|вопрос|frage|pregunta|q|you asked|вы спросили|ihre frage|su pregunta)\s*:\s*)+", re.I)
_TOKEN = re.compile(r"\w+")

#: Patterns, and substrings one of which any of their matches holds (None: no such list).
_PERSONS = frozenset("i we this the as my я мне меня мы нам мой этот ich mir mich wir uns yo me mi puedo tengo dispongo voy debo siento lamento не".split())
_TESTS = {
    "negative": (_NEGATIVE, ("not", "n't", "n’t", "unable", "won", "must", "decline", "refuse", "no ", "insufficient", "sorry, no", "couldn", "could n", "не ", "нельзя", "нет ", "запрещено", "отказываюсь", "недостаточно", "nicht", "kein", "niego")),
    "first": (_FIRST, None),
    "help": (_HELP, ("help", "answer", "assist", "discuss", "share", "provide", "comment", "tell", "say", "access", "disclose", "talk", "respond", "reply", "information", "request", "question", "show", "reveal", "помо", "отве", "обсужд", "показ", "сообщ", "предостав", "информаци", "рассказ", "комментир", "раскры",
                     "вопрос", "запрос", "helfen", "beantwort", "antwort", "zugriff", "auskunft", "sagen", "besprechen", "teilen", "zeigen", "anfrage", "kommentieren", "ayudar", "hablar", "compartir", "comentar", "informaci", "mostrar", "contestar", "consulta", "pregunta", "solicitud", "revelar")),
    "apology": (_APOLOGY, ("sorry", "unfort", "apolog", "regret", "извин", "сожал", "прости", "leider", "leid", "entsch", "bedau", "siento", "lamen", "disculp", "desgracia", "perdon")),
    "scope": (_SCOPE, ("outside", "beyond", "выход", "вне", "разрешено", "außerhalb", "ausserhalb", "fuera", "something")),
    "courtesy": (_COURTESY, ("please", "thank", "try ", "contact", "ask ", "пожалуйста", "переформулируйте", "обратитесь", "спасибо", "bitte", "danke", "por favor", "gracias", "hope", "good question", "is there", "feel free")),
    "greeting": (_GREETING, ("sorry", "short", "good", "looked", "извините", "коротко", "kurz", "entschuldig", "breve", "perd", "disculp", "hello", "hi", "hallo", "hola", "привет", "sure", "of course", "конечно", "gern", "claro")),
    "sources": (_SOURCES, (":",)),
}
FEATURES = (
    "bias", "negative", "first", "help", "apology", "scope", "courtesy", "quote", "negative+help", "negative+first", "negative+first+help", "apology+negative",
    "short", "long", "stand", "stand+negative", "code", "open", "item", "path", "sources", "greeting", "echo", "echo_half", "echo_little", "foreign", "same_language",
    "no_language", "last", "complete", "last+incomplete", "open_tick", "first_clause", "only",
)
_AT = {f: i for i, f in enumerate(FEATURES)}


def featurize(question: str | None, answer: str) -> tuple[list[tuple[str, str]], np.ndarray]:
    """The clauses of an answer, and the feature matrix of each."""
    parts = clauses(answer)
    q = question or ""
    allowed = asked_languages(q)
    own = question_language(q)
    have: dict[str, int] = {}
    for w in _TOKEN.findall(q.casefold()):
        have[w] = have.get(w, 0) + 1
    x = np.zeros((len(parts), len(FEATURES)))
    for n, (kind, text) in enumerate(parts):
        on = ["bias"]
        last = n == len(parts) - 1
        if kind in ("code", "open"):
            on.append(kind)
        else:
            quote = ('"' in text or "“" in text or "«" in text or "„" in text) and bool(_QUOTE.search(text))
            bare = _QUOTE.sub(" ", text) if quote else text
            low = bare.casefold()
            words = _TOKEN.findall(low)
            got = {k for k, (p, signs) in _TESTS.items() if (any(x in low for x in signs) if signs is not None else not _PERSONS.isdisjoint(words)) and p.search(bare)}
            if "greeting" in got:
                got -= {"apology", "negative", "help"}
            on += got
            if quote:
                on.append("quote")
            stand = ("`" in text or "_" in text) and bool(_STAND.search(text))
            if stand:
                on.append("stand")
            for combo in ("negative+help", "negative+first", "negative+first+help", "apology+negative"):
                if set(combo.split("+")) <= got:
                    on.append(combo)
            if stand and "negative" in got:
                on.append("stand+negative")
            if quote or low[:1] == ">" or ":" in low[:20] or low[:1].isspace():
                words = _TOKEN.findall(_PREFIX.sub("", text).casefold())
            on.append("short" if len(words) <= 14 else "long")
            if kind == "item":
                on.append("item")
            item = _ITEM.match(text)
            rest = text[item.end() :].strip() if item else text.strip()
            if _PATH.fullmatch(rest) or "sources" in got and _PATH.search(text.strip()):
                on.append("path")
            if q and len(words) >= 2:
                left = dict(have)
                hit = 0
                for w in words:
                    if left.get(w, 0):
                        hit += 1  # a question given back twice still copies: counts aren't used up
                share = hit / len(words)
                on.append("echo" if share >= 0.9 else "echo_half" if share >= 0.65 else "echo_little")
            lang = language(text)
            if lang is None or own is None:
                on.append("no_language")
            elif lang == own or lang in allowed:
                on.append("same_language")
            else:
                on.append("foreign")
            tail = text.rstrip()
            complete = bool(_COMPLETE.search(tail)) or "path" in on or "greeting" in got
            if tail.count("`") % 2:
                on.append("open_tick")
                complete = False
            if re.search(r"[,(\[{/\\]$", tail):
                complete = False
            if kind == "item" and not rest:
                complete = False
            on.append("complete" if complete else "bias")
            if last and not complete:
                on.append("last+incomplete")
        if last:
            on.append("last")
        if n == 0:
            on.append("first_clause")
        if len(parts) == 1:
            on.append("only")
        for f in on:
            x[n, _AT[f]] = 1.0
    return parts, x


# -- the field -------------------------------------------------------------------------------------------------
class Field:
    """A linear-chain conditional random field: state weights for each feature and label, and label transitions."""

    def __init__(self, states: np.ndarray, moves: np.ndarray):
        self.states, self.moves = states, moves

    def tag(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels."""
        s = x @ self.states
        n = len(s)
        best, back = s[0], np.zeros((n, s.shape[1]), int)
        for t in range(1, n):
            step = best[:, None] + self.moves
            back[t] = step.argmax(0)
            best = step.max(0) + s[t]
        out = np.empty(n, int)
        out[-1] = best.argmax()
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    @classmethod
    def train(cls, data: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
        k = len(LABELS)
        states, moves = np.zeros((len(FEATURES), k)), np.zeros((k, k))
        gs, gm = np.full_like(states, 1e-2), np.full_like(moves, 1e-2)
        order = list(range(len(data)))
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                x, y = data[i]
                ds, dm = cls._gradient(x, y, states, moves)
                ds -= decay * states
                dm -= decay * moves
                gs += ds * ds
                gm += dm * dm
                states += rate * ds / np.sqrt(gs)
                moves += rate * dm / np.sqrt(gm)
        return cls(states, moves)

    @staticmethod
    def _gradient(x, y, states, moves):
        s = x @ states
        n, k = s.shape
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha, beta = np.zeros((n, k)), np.zeros((n, k))
        alpha[0] = s[0]
        for t in range(1, n):
            alpha[t] = lse(alpha[t - 1][:, None] + moves, 0) + s[t]
        for t in range(n - 2, -1, -1):
            beta[t] = lse(moves + (s[t + 1] + beta[t + 1])[None, :], 1)
        z = lse(alpha[-1], 0)
        p = np.exp(alpha + beta - z)
        ds = -x.T @ p
        for t in range(n):
            ds[:, y[t]] += x[t]
        dm = np.zeros((k, k))
        for t in range(n - 1):
            dm -= np.exp(alpha[t][:, None] + moves + (s[t + 1] + beta[t + 1])[None, :] - z)
            dm[y[t], y[t + 1]] += 1
        return ds, dm


#: Seed sentences of the training set: sound answers, questions, refusals, courtesies and openings by language.
_SEEDS = {
    "en": {
        "answer": ["Use `open_pool` to read the table first.", "The worker keeps each row until the lock is free.", "If the cache is cold, load it before the merge.", "You cannot call `flush_all` before the pool is open.", "Do not remove the guard from the loader.", "Unfortunately `join_rows` does not support a null key, so wrap it.", "The service answers \"I cannot help you\" when the quota is used up, and that is intended.", "I can't stress enough that `close_pool` must come last.", "That depends on how the reader handles the queue, because the index never stores it.", "We split the request in `open_pool` because the reader often scores a comment.", "We share the answer of `read_rows` because my loader shows the information."],
        "question": ["How can I change the index of the table?", "Why does `read_rows` fail when the cache is cold?", "Show me the code that opens the pool.", "Where does the loader keep its rows?"],
        "refusal": ["I'm sorry, but I can't help with that.", "I cannot answer this question.", "As an assistant I am not able to share the code of that module.", "I am not allowed to discuss this topic.", "This request is outside of what I may talk about.", "I do not have enough information to answer.", "I'd rather not answer that one.", "Sorry, no.", "This bot is not permitted to comment on it.", "Unfortunately, I am unable to provide this information.", "I won't tell you that.", "I must decline this request.", "I don't have access to that module, so I can't say.", "There is not enough information to answer that."],
        "courtesy": ["Please rephrase the question.", "Please contact the maintainers.", "Thanks for asking about `open_pool`."],
        "opening": ["Sorry for the wait.", "Short answer: yes.", "Good question!"],
    },
    "ru": {
        "answer": ["Сначала откройте пул через `open_pool` и прочитайте таблицу.", "Обработчик хранит каждую строку, пока замок не свободен.", "Если кэш пуст, загрузите его до слияния.", "Нельзя вызывать `flush_all` до того, как готов пул.", "К сожалению, `join_rows` не умеет пустой ключ, оберните его.", "Не могу не отметить: `close_pool` и есть последний шаг.", "Сервис отвечает «не могу помочь», когда квота исчерпана, так задумано."],
        "question": ["Как изменить индекс таблицы?", "Почему `read_rows` падает, если кэш пуст?", "Покажи код, который открывает пул.", "Где загрузчик хранит строки?"],
        "refusal": ["Извините, но я не могу помочь с этим вопросом.", "Я не буду отвечать на это.", "Этот запрос выходит за рамки того, что мне разрешено обсуждать.", "К сожалению, у меня нет доступа к этому модулю, поэтому ответить не получится.", "Я не могу показать код этого модуля.", "У меня нет информации для ответа на этот вопрос.", "Отвечать на это я не буду.", "Мне нельзя об этом рассказывать.", "Недостаточно информации, чтобы ответить на этот вопрос."],
        "courtesy": ["Пожалуйста, переформулируйте вопрос.", "Обратитесь к администратору."],
        "opening": ["Извините за задержку.", "Коротко: да."],
    },
    "de": {
        "answer": ["Öffnen Sie zuerst den Pool mit `open_pool` und lesen Sie die Tabelle.", "Der Dienst behält jede Zeile, bis die Sperre frei ist.", "Wenn der Puffer leer ist, laden Sie ihn vor dem Zusammenführen.", "Leider kann `join_rows` keinen leeren Schlüssel lesen, darum die Kopie.", "Ob der Index wächst, hängt davon ab, wie der Leser die Zeile behandelt."],
        "question": ["Wie kann ich den Index der Tabelle ändern?", "Warum wirft `read_rows` einen Fehler, wenn der Puffer leer ist?", "Wo speichert der Lader die Zeilen?"],
        "refusal": ["Tut mir leid, dabei kann ich nicht helfen.", "Das kann ich nicht beantworten.", "Dazu darf ich keine Auskunft geben.", "Ich habe keinen Zugriff auf das Modul und kann das nicht beantworten.", "Diese Anfrage liegt außerhalb dessen, was ich besprechen darf.", "Darüber möchte ich nicht sprechen."],
        "courtesy": ["Bitte formulieren Sie die Frage neu.", "Danke für die Frage."],
        "opening": ["Kurz gesagt: ja.", "Entschuldigung für die Wartezeit."],
    },
    "es": {
        "answer": ["Abre primero el grupo con `open_pool` y lee la tabla.", "El servicio guarda cada fila hasta que el bloqueo está libre.", "Si la memoria está vacía, carga los datos antes de unir.", "No se puede llamar a `flush_all` antes de abrir el grupo.", "Si falla la carga, el índice no recibe el registro y luego borra la cola."],
        "question": ["¿Cómo puedo cambiar el índice de la tabla?", "¿Por qué falla `read_rows` cuando la memoria está vacía?", "¿Dónde guarda el cargador las filas?"],
        "refusal": ["Lo siento, no puedo ayudar con eso.", "No dispongo de información para responder.", "No tengo permitido hablar de ese módulo.", "No puedo responder a esta pregunta.", "Esa consulta está fuera de lo que puedo comentar."],
        "courtesy": ["Por favor, reformula la pregunta.", "Gracias por preguntar."],
        "opening": ["En breve: sí.", "Perdón por la espera."],
    },
}
_BLOCK = "```python\nrows = pool.read(7)\nfor row in rows:\n    print(row)\n```"


def training_pairs(n: int = TRAINING_PAIRS, seed: int = 11) -> list[tuple[str, str, list[int]]]:
    """(question, answer, label of each clause), made from the seeds."""
    rng, out = random.Random(seed), []
    kinds = ["sound"] * 4 + ["refusal"] * 2 + ["echo", "foreign", "unfinished", "unfinished"]
    number = {x: i for i, x in enumerate(LABELS)}
    while len(out) < n:
        lang = rng.choice(list(_SEEDS))
        s, kind = _SEEDS[lang], rng.choice(kinds)
        q = rng.choice(s["question"])
        body: list[tuple[str, str]] = []
        if kind in ("sound", "unfinished"):
            if rng.random() < 0.3:
                body.append((rng.choice(s["opening"]), "answer"))
            body += [(x, "answer") for x in rng.sample(s["answer"], rng.randint(1, 4))]
            if rng.random() < 0.25:
                body.append((_BLOCK, "answer"))
            if rng.random() < 0.2:
                body += [(f"- `part_{i}.py`", "answer") for i in range(2)]
            elif rng.random() < 0.3:
                body.append(("Sources: pool/read_rows.py", "answer"))
            if kind == "unfinished":
                text = rng.choice([*s["answer"], _BLOCK, "- `part_7.py`"])
                cut = text[: rng.randint(max(1, len(text) // 5), max(2, int(len(text) * 0.9)))].rstrip()
                cut = re.sub(r"[.!?:;)\]\"`]+$", "", cut) if not text.startswith("`") else cut
                if not cut.strip() or cut == "```":
                    continue
                body.append((cut, "unfinished"))
        elif kind == "refusal":
            if rng.random() < 0.3:
                body.append((rng.choice(s["courtesy"][-1:]), "refusal"))
            body.append((rng.choice(s["refusal"]), "refusal"))
            if rng.random() < 0.4:
                body.append((rng.choice(s["courtesy"]), "refusal"))
        elif kind == "echo":
            text = rng.choice([q, q.upper(), q.lower(), f"> {q}", f"Question: {q}", q.rstrip("?.")])
            body += [(text, "echo")] * rng.choice([1, 1, 2])
        else:
            other = rng.choice([x for x in _SEEDS if x != lang])
            body += [(x, "foreign") for x in rng.sample(_SEEDS[other]["answer"], rng.randint(1, 3))]
        answer = "\n".join(t for t, _ in body)
        labels: list[int] = []
        for text, label in body:
            labels += [number[label]] * len(clauses(text))
        if labels and len(labels) == len(clauses(answer)):
            out.append((q, answer, labels))
    return out


@lru_cache(maxsize=2)
def trained_field(n: int = TRAINING_PAIRS) -> Field:
    return Field.train([(featurize(q, a)[1], np.array(y)) for q, a, y in training_pairs(n)])


# -- pairs -----------------------------------------------------------------------------------------------------
def defect(field: Field, question: str | None, answer: str | None) -> str | None:
    """The defect of a pair, from the shares of its clauses' tags."""
    if is_empty(answer):
        return "empty"
    parts, x = featurize(question, answer)
    if not parts:
        return "empty"
    tags = field.tag(x)
    weight: dict[str, int] = dict.fromkeys(LABELS, 0)
    prose = 0
    for (kind, text), tag, row in zip(parts, tags, x):
        if row[_AT["greeting"]] and LABELS[tag] == "answer":
            continue
        n = len(text)
        weight[LABELS[tag]] += n
        if kind not in ("code", "open") and not row[_AT["path"]]:
            prose += n
    total = sum(weight.values())
    if not total:
        return None
    if weight["refusal"] and weight["refusal"] >= 0.5 * total:
        return "refusal"
    if weight["echo"] >= 0.8 * total:
        return "copy"
    if prose and weight["foreign"] >= 0.5 * prose:
        return "language"
    if LABELS[tags[-1]] == "unfinished":
        return "truncated"
    return None


def pair_defects(logs: DataFrame, record_id: str = "id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(id, defect) of each pair that has one."""
    field = trained_field()
    rows = logs.select(F.col(record_id).alias("id"), F.col(question).alias("q"), F.col(answer).alias("a"))

    def run(batches):
        for b in batches:
            found = [defect(field, q, a) for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = pa.array([f is not None for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(found, pa.string()).filter(keep)], ["id", "defect"])

    return spread(rows).mapInArrow(run, f"id {dict(rows.dtypes)['id']}, defect string").distinct()
