"""Defective prompt and response pairs (problem 5).

Answers without a closing sign are in doubt, and three steps over all answers decide them.  Answers
sorted by text: one that a neighbour continues within its line is a shortened version.  Runs of
three words sorted by text: an answer's last run is compared with its neighbours there, the same run
or one whose last word goes on; where those mostly run on, the answer was cut.  Lengths at which the
doubts left over pile up are length limits.  Copy, refusal and language rules work on each pair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.texts import HASHES, MIX, U64, mix, words
from loomlake.workspace import small, stored

#: Words that say that there is nothing, alone or beside one that names what is missing (fixed values).
NOTHING = frozenset("none null nil nan na tbd tba todo blank empty undefined missing ninguna vacío vacía nada vide rien aucune leer néant nichts keine vuoto vazio 无 空 无回答".split())
MISSING = frozenset(
    "no not sin pas de ohne kein senza sem content response answer reply text message output result data available given provided contenido respuesta disponible contenu réponse disponible inhalt antwort angabe verfügbar contenuto risposta conteúdo resposta".split()
)
#: Frequent words that tell the languages apart (fixed values); of the last ones only words that the first four lack.
STOPWORDS = {
    "en": "the an of to and is for my on in with under by this what how when who from at or if it your not are be as before after within you have been has was that please i me",
    "es": "el la los las de que y en un una con por para mi se del al su lo como está antes bajo qué desde es si no más cuando sin hasta puedo tras le tengo aunque nadie",
    "fr": "le la les des de et en un une du pour mon ma est que qui dans sur au avec pas il je sous par avant dès si plus lié cette vous ce jusqu ai aux bien toutes mais",
    "de": "der die das den dem ein eine und ist von zu den mit für im ein eine mein nicht auf dem nach vor bei wird zum ich es unter am oder an alle rund sobald bis was in einer aus seit aber kann mich sie",
    "it": "il di che è della delle dei degli nel nella gli questo questa sono non anche più dalla alla allo come perché entro",
    "pt": "não uma em os ao dos das você são também pelo pela isso com mais está até após",
    "nl": "het een van niet wordt zijn voor met aan naar deze dit uw ook kunt binnen wij",
    "pl": "nie się jest że na do przez dla oraz jak który można lub",
}
_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _name, _list in STOPWORDS.items():
    for _word in dict.fromkeys(_list.split()):
        if _name in ("en", "es", "fr", "de") or _word not in _LANGUAGES:
            _LANGUAGES[_word] = (*_LANGUAGES.get(_word, ()), _name)
#: Names of the languages in several languages (fixed values).
NAMES = {
    "en": "english|inglés|anglais|englisch|inglese",
    "es": "spanish|español|castellano|espagnol|spanisch|spagnolo",
    "fr": "french|francés|français|französisch|francese",
    "de": "german|alemán|allemand|deutsch|tedesco",
    "it": "italian|italiano|italien|italienisch",
    "pt": "portuguese|portugués|portugais|portugiesisch|português",
    "nl": "dutch|holandés|néerlandais|niederländisch",
    "pl": "polish|polaco|polonais|polnisch",
    "ru": "russian|ruso|russe|russisch|русск",
    "zh": "chinese|mandarin|chino|chinois|chinesisch|中文",
    "ja": "japanese|japonés|japonais|japanisch",
    "ko": "korean|coreano|coréen|koreanisch",
    "ar": "arabic|árabe|arabe|arabisch",
    "el": "greek|griego|grec|griechisch",
}
#: Letters of scripts that tell a language by themselves (fixed values).
SCRIPTS = {"ja": re.compile("[ぁ-ヿ]"), "ko": re.compile("[가-힣]"), "ru": re.compile("[Ѐ-ӿ]"), "ar": re.compile("[؀-ۿ]"), "el": re.compile("[α-ωΑ-Ω]"), "zh": re.compile("[㐀-鿿]")}
_SCRIPT = re.compile("[ぁ-ヿ가-힣Ѐ-ӿ؀-ۿα-ωΑ-Ω㐀-鿿]")
#: A wish for a language: a preposition of the languages before its name, or a wish to translate.
WISH = {k: re.compile(rf"\b(?:in|into|en|al|auf|ins|na)\s+(?:{v})|\b(?:translat|traduc|tradui|übersetz)", re.I) for k, v in NAMES.items()}

_FENCE = re.compile(r"```.*?```", re.S)
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d+[.)])(?:\s+|$)")
#: A list's number without its item; a German day whose month is missing.
_MARKER = re.compile(r"\s*\d+[.)]")
_ORDINAL = re.compile(r"\b(?:am|dem|vom|zum)\s+\d{1,2}\.$")
_CLOSED = re.compile(r"[.!?。！？](?:[\"'”’»)\]]*)$")
#: Signs that may stand behind an answer's end: those without width and pictures (fixed values).
_BEHIND = re.compile("[\u200b\u200c\u200d\ufeff\ufe0f\u2600-\u27bf\U0001f000-\U0001faff]")
_NUMBER = re.compile(r"\d+")
_SENTENCE = re.compile(r"(?<=[.!?。！？;])\s+|\n+")
#: Letters that only one of the languages uses here (fixed values).
_MARKS = {"es": re.compile("[ñóíú¿¡]"), "fr": re.compile("[çèêàùœîâ]|\\b[ldsnjc]['’]"), "de": re.compile("[ßäöü]")}
#: Words and the signs that end a sentence or a line.
_PIECE = re.compile(r"[^\W_]+|[.!?。！？](?=[\s\"'”’»)\]]|$)|\n")
_ENDS = frozenset(".!?。！？\n")

#: Sentences that decline (patterns of the four languages; fixed values).
REFUSAL = re.compile(
    r"""\b(?:can(?:'|’)?t|can\s?not|could\s?n(?:'|’)t|unable\s+to|not\s+able\s+to|won(?:'|’)t(?:\s+be\s+able\s+to)?|will\s+not|not\s+(?:allowed|permitted|in\s+a\s+position)\s+to
        |(?:do\s+not|don(?:'|’)t)\s+have\s+the\s+ability\s+to|must|have\s+to|(?:'|’)d\s+rather\s+not|prefer\s+not\s+to|rather\s+not|refuse\s+to|not\s+be\s+appropriate\s+for\s+me\s+to|prevents?\s+me\s+from|prohibits?\s+me\s+from)
        (?:\s+\w+){0,3}?\s+(?:help|assist|answer|reply|respond|responding|discuss|discussing|comment|provide|give|talk|share|decline|refuse|stay|address|support|engage|guidance|answering|helping)
    |\b(?:beyond|outside)\s+(?:of\s+)?(?:my|our|the)\s+(?:\w+\s+)?(?:remit|scope|abilit|capabilit|competence|expertise|mandate|purview)|\b(?:have\s+to|must|will|going\s+to|'ll)\s+(?:\w+\s+){0,3}?pass\s+on\b|\bnot\s+(?:comfortable|willing|at\s+liberty|equipped|permitted|allowed|able)\b
    |\b(?:non\s+(?:posso|sono\s+in\s+grado|mi\s+è\s+possibile)|preferisco\s+non|devo\s+(?:rifiutare|declinare))\b|\b(?:não\s+(?:posso|consigo|estou\s+autorizad[oa])|prefiro\s+não|devo\s+recusar)\b|\bkan\s+(?:ik|daar|u)\b(?:\s+\w+){0,4}?\s+niet\b
    |\b(?:kann|darf|möchte|werde|will)\s+(?:ich|wir)(?:\s+\w+){0,5}?\s+(?:nicht|nichts|keine?)\b|\b(?:ich|wir)\s+(?:kann|können|darf|dürfen|möchte|werde|will)(?:\s+\w+){0,6}?\s+(?:nicht|nichts|keine?)\b|\baußerhalb\s+mein|\bnicht\s+in\s+der\s+lage\b|\bsteht\s+mir\s+nicht\s+zu\b
    |\b(?:fuera|más\s+allá)\s+de\s+mi|\bhors\s+de\s+mon|\bne\s+relève\s+pas\b|\bnot\s+something\s+(?:that\s+)?i\s+can\b|\boutside\s+(?:of\s+)?what\s+i(?:\s+a|')?m\s+allowed|\bno\s+comment\b|\bcannot\s+comply\b|\bagainst\s+my\s+(?:guidelines|policy|rules)
    |\bno\s+(?:me\s+es\s+posible|puedo|podemos|me\s+está\s+permitido|estoy\s+autorizad[oa]|quiero)(?:\s+\w+){0,2}?\s*(?:ayudar|responder|contestar|hablar|comentar|opinar|atender|dar)
    |\bprefiero\s+no\b|\bdebo\s+(?:rechazar|declinar|negarme)\b|\bme\s+niego\b|\bno\s+estoy\s+autorizad
    |\b(?:ne|n')\s*(?:peux|puis|pouvons|suis|souhaite)\s+pas(?:\s+\w+){0,4}?\s*(?:aider|répondre|aborder|discuter|parler|commenter|autorisé|mesure|traiter|donner)|\bpréfère\s+ne\s+pas\b
    |\b(?:dois|doit|je)\s+(?:décliner|refuser|décline|refuse)\b|\bimpossible\s+de\s+(?:répondre|vous|traiter|discuter|donner|parler|aider)
    |\bnicht\s+(?:helfen|äußern|beantworten|antworten|besprechen|weiterhelfen|eingehen|unterstützen|sprechen)\b|\bablehnen\b|\bkeine?\s+(?:auskunft|antwort|angaben)\b|\bdarf\s+(?:ich|dazu|hier)(?:\s+\w+){0,5}?\s*(?:nicht|keine)
    """,
    re.I | re.X,
)
#: A turn after the refusal: the sentence goes on to help.
_TURN = re.compile(r"\b(?:but|yet|however|here\s+is|pero|mais|aber|sondern)\b", re.I)
#: Sentences that may stand beside one that declines.
COURTESY = re.compile(
    r"""\b(?:thank|thanks|sorry|apolog|understanding|anything\s+else|something\s+else|afraid|change\s+the\s+subject|regret|unfortunately|topic\s+i|gracias|comprensión|disculp|lo\s+siento|perdon|otra\s+cosa|merci|compréhension|désolé|excus
        |autre\s+chose|danke|dank|verständnis|leid|entschuldig|leider|etwas\s+anderes|dispiace|scus|grazie|desculp|obrigad|dank\s+u)""",
    re.I | re.X,
)


def language(text: str, said: list[str] | None = None) -> str | None:
    """The language of a text by its script or its frequent words; None where too few or no clear lead."""
    if "```" in text:
        text, said = _FENCE.sub(" ", text), None
    plain = text.isascii()
    if not plain and _SCRIPT.search(text):
        for name, script in SCRIPTS.items():
            if len(script.findall(text)) * 3 > len(text):
                return name
    score: Counter[str] = Counter()
    for w, n in Counter([w for w in (words(text) if said is None else said) if w in _LANGUAGES]).items():
        known = _LANGUAGES[w]
        for x in known:
            score[x] += n / len(known)
    if not plain:
        low = text.lower()
        for name, mark in _MARKS.items():
            hits = len(mark.findall(low))
            if hits:
                score[name] += min(hits, 3)
    best = score.most_common(2)
    if not best or best[0][1] < 2:
        return None
    return best[0][0] if len(best) < 2 or best[0][1] >= 1.2 * best[1][1] else None


def is_empty(answer: str | None, bare: list[str] | None = None) -> bool:
    """No word at all, or only words that say so: one of NOTHING, or "no" or "not" with what is missing."""
    if answer is None:
        return True
    bare = words(answer) if bare is None else bare
    if len(bare) > 4:
        return False
    if not bare or all(w in NOTHING for w in bare) or " ".join(bare) in ("n a", "k a"):
        return True
    return all(w in NOTHING or w in MISSING for w in bare) and (any(w in NOTHING for w in bare) or len(bare) > 1)


def is_copy(question: str, answer: str, q: list[str] | None = None, a: list[str] | None = None) -> bool:
    """The answer's words, but for a lead-in, are the question's and cover most of it; of a question
    asked again, most of them."""
    q, a = words(question) if q is None else q, words(answer) if a is None else a
    if len(a) < 4 or len(q) < 4:
        return False
    known, there = set(q), Counter(q)
    new = sum([w not in known for w in a])
    if new > 0.4 * len(a) and ":" not in answer:
        return False
    shared = sum((Counter(a) & there).values())
    if new <= max(2, len(a) // 12) + (3 if ":" in answer.split("\n", 1)[0] else 0) and shared >= 0.8 * len(q) and (len(a) - new) / len(a) >= 0.75:
        return True
    again = question.rstrip().endswith("?") and answer.rstrip().endswith("?") and not any(w not in known and not w.isalpha() for w in a)
    return again and shared >= 0.6 * len(q) and new <= 0.4 * len(a)


#: Words of which every refusal has one.
DECLINES = frozenset(
    """
can cannot could couldn unable able will won must have has ability rather prefer refuse appropriate prevent prevents prohibit prohibits not comment against beyond outside allowed ll pass
no puedo podemos prefiero debo niego fuera allá ne n préfère dois doit je impossible hors nicht nichts ablehnen keine kein darf dürfen kann können möchte werde will außerhalb
non posso preferisco devo não prefiro kan
""".split()
)


def is_refusal(answer: str, said: list[str] | None = None) -> bool:
    """Does every sentence decline or say something polite, but for at most three words?"""
    if "```" in answer or DECLINES.isdisjoint(words(answer) if said is None else said):
        return False
    declined, rest = False, 0
    for sentence in _SENTENCE.split(answer.strip()):
        found = REFUSAL.search(sentence)
        if found and not _TURN.search(sentence, found.end()) and '"' not in sentence:
            declined = True
        elif not COURTESY.search(sentence) and len(words(sentence)) > 1:
            rest += len(words(sentence))
            if rest > 3:
                return False
    return declined


def bare_end(text: str) -> str:
    """The text without white space, signs without width and pictures at its end."""
    end = len(text)
    while end and (text[end - 1].isspace() or (text[end - 1] > "\u2000" and _BEHIND.match(text[end - 1]))):
        end -= 1
    return text[:end]


def unfinished(answer: str) -> str | None:
    """'cut' for an answer that shows that it breaks off, 'doubt' for one that only lacks a closing
    sign, None for a finished one."""
    text = bare_end(answer)
    if text.count("```") % 2:
        return "cut"
    if not text or text.endswith("```"):
        return None
    if text.count('"') % 2 and text.endswith('"'):
        return "cut"
    if text.endswith(("...", "…")):
        return "cut"
    last = text.rsplit("\n", 1)[-1]
    if _MARKER.fullmatch(last) and "\n" in text or _ORDINAL.search(text):
        return "cut"
    if _CLOSED.search(text):
        return None
    item = _ITEM.match(last)
    if item and not words(last[item.end() :]):
        return "cut"
    if text[-1] in ')]"”»' and text.count("(") == text.count(")"):
        return None
    count = len(words(text))
    if text[-1] in ",:;(–—-[{„«":
        return "cut" if count > 3 or text[-1] in ",(" else None
    return "doubt" if item or count > 4 or (count == 4 and not _NUMBER.search(text)) else None


def masked(word: str) -> str:
    return word if word.isalpha() else "#"


def tail(answer: str) -> tuple[str, bool]:
    """(words, closed): the last three words, numbers as #, with ^ for the start of the sentence or
    line; and whether an earlier sentence of the answer has its closing sign, outside of lists."""
    text = bare_end(answer)
    end = max((m.start() for m in re.finditer(r"[.!?。！？](?=\s)|\n", text)), default=-1)
    w = ["^", "^", *map(masked, words(text[end + 1 :]))]
    closed = bool(re.search(r"[.!?。！？](?=\s)", _MARKERS.sub("", text))) and not _ITEM.match(text[text.rfind("\n") + 1 :])
    return " ".join(w[-3:]), closed


_MARKERS = re.compile(r"^\s*\d+[.)]\s", re.M)


def defect_of(question: str, answer: str | None) -> tuple[str | None, str | None]:
    """(defect, doubt): 'cut' and 'doubt' as ``unfinished`` gives them, for an answer without another
    defect; a cut answer is truncated whatever other answers say."""
    a = words(answer) if answer else []
    if is_empty(answer, a):
        return "empty", None
    q = words(question)
    if is_copy(question, answer, q, a):
        return "copy", None
    if is_refusal(answer, a):
        return "refusal", None
    asked, given = language(question, q), language(answer, a)
    if asked and given and asked != given and not WISH[given].search(question):
        return "other_language", None
    state = unfinished(answer)
    return ("truncated" if state == "cut" else None), state


class Marks(dict):
    """word or sign -> hash; signs that end a unit are 0, numbers alike."""

    def __missing__(self, w: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        value = self[w] = 0 if w in _ENDS else HASHES[masked(w)] | 2
        return value


_MARKED = Marks()


def windows(answers: list[str], finished: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(window, ended, n): different runs of three words of one sentence or line, ^ standing before its
    first word; whether it ends there; and how often.  An unfinished answer's last run is left out."""
    tokens = [_PIECE.findall(a.lower()) for a in answers]
    names: list[str] = ["\n", "\n"]
    for t, whole in zip(tokens, finished, strict=True):
        names += t
        names += ("\n", "\n") if whole else ("", "\n", "\n")
    flat = np.fromiter((_MARKED[x] if x else 1 for x in names), U64, len(names))
    at = np.flatnonzero((flat[2:-1] > 1) & (flat[3:] != 1)) + 2
    if not len(at):
        return [], np.empty(0, bool), np.empty(0, np.int64)
    ended, b, c = flat[at + 1] == 0, flat[at - 1], flat[at]
    a = np.where(b == 0, U64(0), flat[at - 2])
    with np.errstate(over="ignore"):
        key = mix(mix(mix(a * U64(MIX[0])) + b) + c) & ~U64(1) | ended.astype(U64)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    names = ["^" if f == 0 else w if w.isalpha() else "#" for f, w in zip(flat.tolist(), names, strict=True)]
    made = [f"{'^' if names[i - 1] == '^' else names[i - 2]} {names[i - 1]} {names[i]}" for i in at[first].tolist()]
    return made, ended[first], n


def pairs_of(samples: DataFrame) -> DataFrame:
    """(sample_id, msg_index, question, answer) of every user message and the assistant message
    without tool calls right after it."""
    at = F.expr(
        """filter(sequence(1, greatest(size(messages) - 1, 1)), i -> i < size(messages) AND messages[i - 1].role = 'user' AND messages[i].role = 'assistant'
           AND coalesce(size(messages[i].tool_calls), 0) < 1)"""
    )
    rows = samples.where("sample_id IS NOT NULL AND size(messages) > 1").select("sample_id", "messages", F.explode(at).alias("i"))
    return rows.select("sample_id", F.col("i").cast("long").alias("msg_index"), F.expr("messages[i - 1].content").alias("question"), F.expr("messages[i].content").alias("answer"))


#: Answers, and the counted runs of words, in one table: a row has either an id or a run.
JUDGED = "sample_id string, msg_index long, defect string, state string, answer string, closed boolean, run string, ended boolean, n long"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int64()]
_NAMES = [f.split()[0] for f in JUDGED.split(", ")]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, texts, finished = [], [], []
        for sid, at, q, a in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            defect, state = defect_of(q or "", a)
            if defect or state:
                run, closed = tail(a) if state == "doubt" else (None, None)
                rows.append((sid, at, defect, state, a if state else None, closed, run, None, None))
            if defect is None:
                texts.append(a)
                finished.append(state is None)
        runs, ended, n = windows(texts, finished)
        columns = list(zip(*rows, strict=True)) or [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)
        none = [pa.nulls(len(runs), k) for k in _KINDS[:6]]
        yield pa.RecordBatch.from_arrays([*none, pa.array(runs, pa.string()), pa.array(ended), pa.array(n)], names=_NAMES)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted different answers -> (kind, answer): 'short' for one that a later one continues within
    its line, 'open' for one that the next partition's answers may still continue.

    The answers that begin the one at hand are kept, each a beginning of the next: a shortened
    version is found however many others lie between it and its continuation.
    """
    held: list[tuple[str, bool]] = []

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["kind", "answer"])

    for part in batches:
        rows = []
        for text in part.column(0).to_pylist():
            while held and not text.startswith(held[-1][0]):
                held.pop()
            for i, (start, done) in enumerate(held):
                if not done and text[len(start)] != "\n":
                    rows.append(("short", start))
                    held[i] = (start, True)
            held.append((text, unfinished(text) != "doubt"))
        yield batch(rows)
    yield batch([("open", start) for start, done in held if not done])


def shortened(pairs: DataFrame, least: int = 40) -> DataFrame:
    """(answer): answers in doubt, of at least ``least`` characters, that another answer continues
    within the same line.

    All different answers are range-partitioned and sorted, and each is compared with those that
    begin it.  What is still open at a partition's end, a few answers, is sought by its first
    ``least`` characters in all answers.
    """
    different = pairs.where(F.length("answer") >= least).select("answer").distinct()
    marked = stored(different.repartitionByRange("answer").sortWithinPartitions("answer").mapInArrow(_open, "kind string, answer string"), "sorted")
    rest = marked.where("kind = 'open'").select(F.substring("answer", 1, least).alias("start"), F.col("answer").alias("short"))
    if rest.isEmpty():
        return marked.where("kind = 'short'").select("answer")
    longer = pairs.where(F.length("answer") > least).withColumn("start", F.substring("answer", 1, least))
    goes_on = F.expr("startswith(answer, short) AND length(answer) > length(short) AND substring(answer, length(short) + 1, 1) <> '\n'")
    across = longer.join(small(rest, 2000), "start").where(goes_on).select(F.col("short").alias("answer"))
    return marked.where("kind = 'short'").select("answer").union(across)


def length_spikes(doubts: DataFrame, least: int = 5) -> DataFrame:
    """(size): lengths that at least ``least`` different answers in doubt have, and more than five
    times as many as the mean of the ten lengths around them: the marks of a length limit."""
    sizes = stored(doubts.select("answer").distinct().groupBy(F.length("answer").alias("size")).agg(F.count("*").alias("n")), "sizes")
    around = sizes.select(F.explode(F.sequence(F.col("size") - 5, F.col("size") + 5)).alias("size"), F.col("size").alias("other"), "n").where("size <> other")
    near = around.groupBy("size").agg(F.sum("n").alias("near"))
    return sizes.join(near, "size", "left").where((F.col("n") >= least) & (F.col("n") > 5 * F.coalesce("near", F.lit(0)) / 10)).select("size")


def _beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, asked, on, ended) sorted by run -> (run, on, ended) of the asked ones: what their
    neighbours, the same run and the ones it begins, do."""
    held: list[list] = []

    def batch(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["run", "on", "ends"])

    for part in batches:
        rows = []
        for run, asked, on, ended in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            while held and not run.startswith(held[-1][0]):
                rows.append(tuple(held.pop()))
            for h in held:
                h[1] += on + ended  # a longer word goes on
            if asked:
                held.append([run, on, ended])
        yield batch(rows)
    yield batch([tuple(h) for h in held])


def neighbours(judged: DataFrame) -> DataFrame:
    """(pair, on, ends): for the last run of each answer in doubt, how often its neighbours among all
    sorted runs of words go on, and how often they end a sentence or line.

    Runs with the same first two words lie in one task; their number is bounded by the vocabulary.
    """
    counted = judged.where("n IS NOT NULL").groupBy("run").agg(F.sum(F.when(F.col("ended"), 0).otherwise(F.col("n"))).alias("on"), F.sum(F.when(F.col("ended"), F.col("n")).otherwise(0)).alias("ends"))
    asked = judged.where("state = 'doubt' AND defect IS NULL").select("run", F.lit(True).alias("asked")).distinct()
    first = small(stored(asked.select(F.substring_index("run", " ", 2).alias("first")).distinct(), "first"), 96)
    both = counted.join(asked, "run", "full").withColumn("first", F.substring_index("run", " ", 2)).join(first, "first", "left_semi")
    rows = both.select("first", "run", F.coalesce("asked", F.lit(False)).alias("asked"), F.coalesce("on", F.lit(0)).alias("on"), F.coalesce("ends", F.lit(0)).alias("ends"))
    placed = rows.repartition("first").sortWithinPartitions("run").select("run", "asked", "on", "ends")
    return placed.mapInArrow(_beside, "run string, on long, ends long")


#: Words after which no sentence ends.
OPEN = (
    "the a an my your our its of to and or but with for from by under into than if der die das den dem des ein eine einen einem einer eines kein keine mein meine und oder aber mit für von zu vom zum zur "
    "le la les des du de et ou un une au aux pour avec sans sous mon ma dans el los las del al una y o con para por sin mi en il lo gli e per di che"
).split()


def judged_answers(samples: DataFrame) -> DataFrame:
    """(sample_id, msg_index, defect, step): every defective pair once with its only defect, and the
    step that decided it: 'rule' for what the pair shows by itself, 'shortened', 'neighbours' or
    'limit', and 'style' where no other answer tells anything.

    Order of the rules: empty, copy, refusal, other_language, truncated.  A null answer is empty; a
    null question is an empty one.  An answer in doubt is truncated if another one continues it; if
    the neighbours of its last run of words end no oftener than runs do on the whole (where earlier
    sentences of the answer have their signs: unless they always end); without such neighbours, if
    its length is a limit, it ends in an article or preposition, or earlier sentences have their
    signs.  Redelivered rows count once; no rows give none; other columns are ignored.
    """
    pairs = pairs_of(samples)
    judged = stored(pairs.mapInArrow(_judge, JUDGED), "judged")
    sure = judged.where("defect IS NOT NULL").select("sample_id", "msg_index", "defect", F.lit("rule").alias("step"))
    doubt = judged.where("state = 'doubt' AND defect IS NULL").select("sample_id", "msg_index", "answer", "closed", "run")
    usual = judged.where("n IS NOT NULL").agg((F.sum(F.when(F.col("ended"), F.col("n"))) / F.sum("n")).alias("usual")).first().usual or 0.0
    near = small(stored(neighbours(judged), "beside"), 160)
    cut = small(stored(shortened(pairs).distinct().withColumn("continued", F.lit(True)), "shortened"), 2000)
    limit = F.broadcast(length_spikes(doubt).withColumn("limit", F.lit(True)))  # bounded: one row per length with five answers
    told = F.coalesce("on", F.lit(0)) + F.coalesce("ends", F.lit(0)) > 0
    runs_on = F.when(F.col("closed"), F.col("on") > 0).otherwise(F.col("ends") <= usual * (F.col("on") + F.col("ends")))
    step = (
        F.when(F.col("continued"), "shortened")
        .when(told, F.when(runs_on, "neighbours"))
        .when(F.col("limit"), "limit")
        .when(F.col("closed") | F.substring_index("run", " ", -1).isin(OPEN), "style")
    )
    late = (
        doubt.join(near, "run", "left")
        .join(cut, "answer", "left")
        .join(limit, F.length("answer") == F.col("size"), "left")
        .select("sample_id", "msg_index", F.lit("truncated").alias("defect"), step.alias("step"))
        .where("step IS NOT NULL")
    )
    return sure.union(late).dropDuplicates(["sample_id", "msg_index"])


def defective_answers(samples: DataFrame) -> DataFrame:
    """(sample_id, msg_index, defect): the rows of ``judged_answers`` without their steps."""
    return judged_answers(samples).drop("step")
