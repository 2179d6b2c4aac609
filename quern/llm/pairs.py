"""Broken prompt and response pairs.

A response is unwrapped (JSON envelope, code fence, label, markup) and turned
into tokens: words in lower case without accents. Copies are found by
aligning the tokens with those of the prompt: containment of the response's
token pairs picks the candidates, the longest common subsequence decides.
Refusals are aligned with refusal templates in the same way, sentence by
sentence. What is left is tested for a broken-off end and for its language.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How a response says that it has nothing to say; a star stands for up to five words.
REFUSALS = {
    "en": """i don't know
i do not know
i'm not sure
i have no information about *
i do not have enough information to answer this question
i cannot answer this question
i am unable to answer
i can't help with that
i'm sorry but i can't help with that request
i cannot say anything about * on the basis of these sources
the provided articles don't mention this so i am unable to answer
i don't know based on the *
unfortunately nothing in the knowledge base covers * please contact support
sorry no answer could be found for your question
i would rather not answer this
that is outside of what i can discuss
as an assistant i'm not able to respond to that
we are not in a position to comment on *
that question falls outside the material available to me
this is not covered by the documents i have
i could not find anything about *
there is no information about * in the sources
i am not able to help with this request
the documentation does not say
i have no answer to that""",
    "de": """das weiß ich leider nicht
das weiß ich nicht
ich weiß es nicht
dazu liegen mir leider keine angaben vor
diese frage kann ich anhand der artikel nicht beantworten
diese frage kann ich leider nicht beantworten
es tut mir leid dabei kann ich nicht helfen
dazu kann ich leider nichts sagen
darüber habe ich keine informationen
dazu habe ich keine informationen
ich kann diese frage nicht beantworten
leider konnte ich keine antwort auf ihre frage finden
die artikel enthalten nichts zu diesem thema
das liegt außerhalb dessen was ich beantworten kann
ich möchte diese frage lieber nicht beantworten""",
    "fr": """je ne sais pas
je n'ai pas assez d'éléments pour vous répondre
je suis désolé je ne peux pas répondre à cette question
je ne peux pas répondre à cette question
les articles ne contiennent rien à ce sujet
je n'ai aucune information à ce sujet
désolé je ne peux pas vous aider
je n'ai pas d'informations sur *
je ne suis pas en mesure de répondre à cette question
je n'ai trouvé aucune réponse à votre question
la documentation ne précise pas ce point
je préfère ne pas répondre à cette question""",
    "es": """no lo sé
no tengo información suficiente para responder a esta pregunta
lo siento no puedo ayudar con eso
los artículos no dicen nada sobre este tema
no puedo responder a esta pregunta
no tengo información sobre *
no estoy en condiciones de responder a esta pregunta
no he encontrado ninguna respuesta a su pregunta
la documentación no dice nada al respecto
prefiero no responder a esta pregunta
lo siento no lo sé""",
    "it": """non lo so
mi dispiace non posso aiutarti con questo
non ho abbastanza informazioni per rispondere a questa domanda
non posso rispondere a questa domanda
non ho informazioni su *
gli articoli non dicono nulla su questo argomento""",
    "pt": """não sei
lamento mas não posso ajudar com isso
não tenho informação suficiente para responder a esta pergunta
não posso responder a esta pergunta
os artigos não dizem nada sobre este tema""",
    "nl": """dat weet ik niet
het spijt me daar kan ik niet mee helpen
ik heb niet genoeg informatie om deze vraag te beantwoorden
ik kan deze vraag niet beantwoorden
de artikelen zeggen hier niets over""",
    "pl": """nie wiem
przykro mi nie mogę w tym pomóc
nie mam wystarczających informacji aby odpowiedzieć na to pytanie
nie mogę odpowiedzieć na to pytanie
artykuły nic o tym nie mówią""",
}
# Sentences of courtesy around an answer, in all languages.
COURTESY = """hi there
hello
thank you for reaching out
thanks for your question
good question
hallo
guten tag
danke für ihre frage
vielen dank für ihre frage
bonjour
merci pour votre message
merci pour votre question
hola
buenos días
gracias por su mensaje
gracias por su pregunta"""
# What introduces a question that is only given back.
LEADS = """re
question
you asked
your question
so you would like to know
frage
ihre frage
sie fragen
sie möchten also wissen
question
vous demandez
votre question
vous voulez donc savoir
pregunta
su pregunta
usted pregunta
entonces quiere saber"""
# Written where a value is missing.
PLACEHOLDERS = {"null", "none", "nil", "na", "n a", "nan", "undefined", "tbd", "todo", "empty", "no content", "leer", "vide", "vacio", "answer", "antwort", "reponse", "respuesta"}
# Frequent words that belong to one of the languages.
FREQUENT = {
    "en": "the a an and of to is are was in on for with that this it you your can how do does where what which why when if i we our by from at as be not or",
    "de": "der die das den dem des ein eine einen einem einer und ist sind war im in auf für mit dass es sie ihr ihre ihren kann können wie wo was warum wenn ich wir unser unsere von bei als nicht oder zu zum zur nach wird werden noch aus um darf man",
    "fr": "le la les un une des et est sont était dans sur pour avec que ce cette il elle vous votre peut comment où quoi pourquoi quand si je nous notre par du de au aux en ne pas ou plus est-ce qui se puis-je",
    "es": "el la los las un una y es son era en para con que este esta se usted su puede cómo dónde qué por cuando si yo nosotros nuestro nuestra del de al no o más ya lo",
    "it": "il gli della delle degli di che sono nel nella questo quello come perché non anche dei alla alle dal può puoi quando dove essere ogni loro suo",
    "pt": "o a os as um uma e é são em no na dos das do da para com que não seu sua você pode quando onde isso este esta pelo pela também ao",
    "nl": "de het een en van is zijn op te dat niet voor met deze wordt worden kunt je u uw naar ook aan bij als maar door hoe waar wanneer",
    "pl": "i w na do się jest nie to że z jak po dla od może są lub oraz przez ten ta co gdzie kiedy aby można pan czy jego",
}
# Names of the languages in each other.
NAMES = {
    "en": "english englisch anglais inglés",
    "de": "german deutsch allemand alemán",
    "fr": "french französisch français francés",
    "es": "spanish spanisch espagnol español",
    "it": "italian italienisch italien italiano",
    "pt": "portuguese portugiesisch portugais portugués português",
    "nl": "dutch niederländisch néerlandais neerlandés nederlands",
    "pl": "polish polnisch polonais polaco polski",
}
DEFECTS = ("empty", "refusal", "echo", "truncated", "language")

_TOKEN = re.compile(r"[^\W_]+")
_LABEL = re.compile(r"^\s*(?:\*\*|__)?(?:answer|antwort|réponse|respuesta)\s*:?\s*(?:\*\*|__)?\s*:?", re.I)
_CITED = re.compile(r"\s*\[[A-Za-z0-9_\-, ]+\]\s*$")
_INVISIBLE = re.compile(r"[​-‏⁠﻿­]")
_ENVELOPE = re.compile(r'^\s*\{\s*"answer"\s*:\s*')
_SENTENCE = re.compile(r"[.!?。…\n]+")
_END = re.compile(r"""[.!?。…][)\]}"'”’»`*_]*$""")


def folded(text: str) -> str:
    text = text.casefold().replace("’", "'")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)) if not text.isascii() else text


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(folded(text).replace("'", ""))


def longest_common(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one number, so a step takes a whole row."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    row = whole = (1 << len(a)) - 1
    for y in b:
        if held := places.get(y):
            hit = row & held
            row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


def unwrap(answer: str) -> tuple[str, bool]:
    """The content inside a JSON envelope, code fence, label and markup, and whether the envelope breaks off."""
    text, broken = _INVISIBLE.sub("", answer).strip(), False
    if text.startswith("```"):
        inner = re.sub(r"^```[\w-]*\s*", "", text)
        if inner.lstrip().startswith("{") or inner.strip() in ("", "```"):
            broken = bool(inner.strip()) and not inner.rstrip().endswith("```")
            text = re.sub(r"\s*```\s*$", "", inner).strip()
    if m := _ENVELOPE.match(text):
        try:
            value = json.loads(text, strict=False).get("answer")
            text = "" if value is None else str(value)
        except ValueError:
            body = text[m.end() :]
            closed = re.match(r'"((?:[^"\\]|\\.)*)"', body)
            text, broken = (closed[1] if closed else body.lstrip('"')), True
    if "<" in text:
        text = re.sub(r"</?[a-zA-Z][^<>]*>|&nbsp;", " ", text)
    return _LABEL.sub("", text.replace("\\n", "\n").replace("\\t", "\t")).strip(), broken


def _templates() -> list[tuple[list[str], int, set[str]]]:
    lines = [line for block in REFUSALS.values() for line in block.split("\n")]
    return [(tokens(x), 5 * x.count("*"), set(tokens(x))) for x in lines]


TEMPLATES = _templates()
#: Words that one template can cover at most, give or take two.
LONGEST = max(len(t) + room for t, room, _ in TEMPLATES) + 2
_COURTESY = sorted((tokens(x) for x in COURTESY.split("\n")), key=len, reverse=True)
_LEADS = sorted({tuple(tokens(x)) for x in LEADS.split("\n")}, key=len, reverse=True)
_FREQUENT: dict[str, set[str]] = {}
for _k, _v in FREQUENT.items():  # a word counts for the first language that lists it among those after the fourth
    _FREQUENT[_k] = {t for w in _v.split() for t in tokens(w)} - (set().union(*_FREQUENT.values()) if len(_FREQUENT) >= 4 else set())
_NAMES = {t: k for k, v in NAMES.items() for t in tokens(v)}


def _without(words: list[str], starts: list) -> list[str]:
    for s in starts:
        if len(words) >= len(s) and words[: len(s)] == list(s):
            return words[len(s) :]
    return words


def _candidates(words: Sequence[str]) -> list[tuple[list[str], int]]:
    """The templates most of whose words occur at all."""
    have = set(words)
    return [(t, room) for t, room, own in TEMPLATES if len(have & own) >= 0.85 * len(own)]


def _covered(words: Sequence[str], templates: list[tuple[list[str], int]]) -> bool:
    """Whether one template aligns with the whole of it, give or take two words."""
    for template, room in templates:
        if len(words) <= len(template) + room + 2 and 0.85 * len(template) <= len(words):
            same = longest_common(template, words)
            if same >= 0.85 * len(template) and len(words) - same <= room + 2:
                return True
    return False


def _reach(words: list[str], templates: list[tuple[list[str], int]]) -> set[int]:
    """Places up to which templates, one behind the other, cover the words."""
    reached, todo = {0}, [0]
    while todo:
        i = todo.pop()
        for template, room in templates:
            j = i + len(template) + room
            if j <= len(words) and j not in reached and longest_common(template, words[i:j]) >= 0.85 * len(template):
                reached.add(j)
                todo.append(j)
    return reached


def refuses(words: list[str]) -> bool:
    """Whether refusal templates, one behind the other, cover the whole of it, courtesy aside.

    Templates are taken off from both ends as far as they align; what is left
    in the middle must be one template, give or take two words.
    """
    words = _without(words, _COURTESY)
    if not words:
        return False
    templates = _candidates(words)
    if not templates or _covered(words, templates):
        return bool(templates)
    heads = _reach(words, templates)
    tails = {len(words) - j for j in _reach(words[::-1], [(t[::-1], room) for t, room in templates])}
    return len(heads) + len(tails) > 2 and any(j in tails and _covered(words[i:j], templates) for i in heads for j in range(i + 2, i + LONGEST + 1))


def refuses_by_sentence(text: str, words: list[str]) -> bool:
    """Whether every sentence is a refusal or a courtesy, and one of them a refusal."""
    templates = _candidates(words)
    if not templates:
        return False
    refused = False
    for sentence in _SENTENCE.split(text):
        rest = _without(tokens(sentence), _COURTESY)
        if rest and not _covered(rest, templates):
            return False
        refused = refused or bool(rest)
    return refused


def echoes(question: list[str], words: list[str]) -> bool:
    """Whether the response is the prompt again, once or more, whatever introduces it: stretches of the prompt's length are aligned with it one by one."""
    words = _without(words, _LEADS)
    if not words or not question:
        return False
    pairs = set(zip(question, question[1:])) or {(question[0],)}
    own = list(zip(words, words[1:])) or [(words[0],)]
    inside = sum(p in pairs for p in own)
    known = set(question)
    held = sum(w in known for w in words)
    if inside < 0.5 * len(own) or held < 0.7 * len(words):
        return False
    size = len(question)
    copies = max(1, round(len(words) / size))
    common = sum(longest_common(question, words[i * len(words) // copies : (i + 1) * len(words) // copies]) for i in range(copies))
    return common >= 0.7 * len(words) and common >= 0.7 * copies * size


def _language(words: list[str], least: int) -> str | None:
    hits = {k: sum(w in v for w in words) for k, v in _FREQUENT.items()}
    first, second = sorted(hits, key=lambda k: -hits[k])[:2]
    return first if hits[first] >= least and hits[first] > 1.4 * hits[second] else None


def breaks_off(text: str, broken: bool) -> bool:
    """Whether prose ends in the middle: no end mark where the rest has them, an open fence or envelope, or a word that asks for more."""
    if broken or text.count("```") % 2:
        return True
    text = _CITED.sub("", text).rstrip()
    if not text or text.endswith("```") or _END.search(text):
        return False
    if text[-1] in ",;:(-–—" or text.endswith(" ("):
        return True
    line = text.rsplit("\n", 1)[-1].strip()
    body = re.sub(r"^(?:[-*•–]|\d+[.)])\s+", "", line)
    before = text[: len(text) - len(line)].rstrip()
    last = re.split(r"(?<=[.!?])\s+", body)[-1]
    if last != body:
        return not re.search(r"^[(\[].*[)\]]$", last)  # the sentences before it are closed
    if before and re.search(r"[.!?]$", _CITED.sub("", before.split("\n")[-1].rstrip())):
        return True
    if body != line or not body:
        return False  # items without marks throughout
    if re.search(r"""(?:\s[>›→]\s|https?://\S+$|["”“»)\]]$|\w\+\w+$)""", body) or not body[-1].isalnum():
        return False
    words = tokens(body)
    if re.match(r"(?:yes|no|ja|nein|oui|non|s[ií])\b", body, re.I) and len(words) <= 6:
        return False
    frequent = any(words[-1] in v for v in _FREQUENT.values())
    return len(words) >= 3 if not before else len(words) >= 6 or frequent


def defect(question: str | None, answer: str | None) -> str | None:
    """The one kind of defect of a pair, or None; see `flag_pairs`."""
    content, broken = unwrap(answer or "")
    words = tokens(content)
    if not words and not re.search(r"[^\W_]", content):
        return None if re.search(r"[\U0001F300-\U0001FAFF☀-➿]", content) else "empty"
    if " ".join(words) in PLACEHOLDERS:
        return "empty"
    if not broken and (refuses(words) or refuses_by_sentence(content, words)):
        return "refusal"
    asked = tokens(question or "")
    if echoes(asked, words):
        return "echo"
    if breaks_off(content, broken):
        return "truncated"
    mine, theirs = _language(words, 3), _language(asked, 2)
    if mine and theirs and mine != theirs and not any(_NAMES.get(w) == mine for w in asked):
        return "language"
    return None


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [defect(q, a) for q, a in zip(batch.column("q").to_pylist(), batch.column("a").to_pylist())]
        flags = pa.array(found, pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), flags], ["id", "defect"]).filter(flags.is_valid())


def flag_pairs(df: DataFrame, key: str = "response_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(key, defect) of every defective pair.

    `empty`: nothing to read (null, blank, placeholders, empty wrappers);
    `refusal`: refusal templates cover the response; `echo`: the response is
    the prompt again; `truncated`: it breaks off; `language`: most of it is in
    another of the known languages than the prompt, which does not ask for
    it. The first that holds is reported. A null prompt can only leave
    `empty`, `refusal` and `truncated`. Each row is judged alone: no shuffle,
    repeated rows give repeated flags, null keys are kept and other columns
    are ignored.
    """
    rows = df.select(F.col(key).alias("id"), F.col(question).cast("string").alias("q"), F.col(answer).cast("string").alias("a"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_flag, f"id {kind}, defect string").withColumnRenamed("id", key)
