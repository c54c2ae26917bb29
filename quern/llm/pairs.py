"""Defects of question-answer pairs (queries p3_).

Rules are applied in a fixed order to the consistent form of both texts, and
every kind that a rule finds is given:

1. emptiness: null, nothing visible, or a filler that stands for nothing;
2. unclosed delimiters: brackets, quotation marks, announced lists;
3. abrupt endings: the last line stops inside a word, sentence or list;
4. refusals: phrases of twelve languages, with at most where else to ask;
5. copied prefixes: the question is taken off the front of the answer, with what
   frames it, as often as it is said; nothing else is left. One that was edited
   since is aligned with it word by word;
6. script mismatch: the main scripts of question and answer differ, or within
   one script the languages do.

Rules 2 and 3 both mean ``truncated_answer``. An empty answer is nothing else.
``defect`` is the first of the kinds in order of ``KINDS``: what an answer says
tells more than how it ends.

Defined results: a null or blank question has no copy and no other language;
repeated rows give equal rows; very long texts are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.forms import consistent

KINDS = ("empty_answer", "copied_question", "refusal", "other_language", "truncated_answer")


class _Bare(dict):
    """Characters without their accents."""

    def __missing__(self, c: int) -> str:
        parts = unicodedata.normalize("NFD", chr(c))
        self[c] = "".join(x for x in parts if not unicodedata.combining(x))
        return self[c]


_bare = _Bare({ord("đ"): "d"})


def folded(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else text.translate(_bare)


# Fixed values, without accents: answers that stand for "nothing".
FILLERS = {
    "n a", "na", "nan", "nil", "null", "none", "nothing", "empty", "blank", "tbd", "tba", "todo", "undefined", "unknown", "no answer", "no data", "to be updated", "updating", "coming soon", "not available", "pending", "test", "x", "xx", "xxx",
    "trong", "rong", "de trong", "bo trong", "khong", "khong co", "khong ro", "chua co", "chua ro", "chua co cau tra loi", "chua tra loi", "chua cap nhat", "dang cap nhat", "se cap nhat", "se cap nhat sau", "cap nhat sau", "dang bo sung", "bo sung sau", "cho cap nhat", "dang xu ly", "dang soan", "khong co du lieu", "khong co noi dung", "chua co noi dung", "chua co du lieu", "noi dung dang cap nhat", "noi dung dang duoc cap nhat",
    "tra loi", "cau tra loi", "dap an", "answer", "reply", "response", "a", "hoi", "question",
}
MOST_FILLED = max(len(x.replace(" ", "")) for x in FILLERS)
_tags = re.compile(r"<[^<>]{0,80}>|&(?:nbsp|amp|lt|gt|quot|#\d+);?", re.I)
_words = re.compile(r"[^\W_]+")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    shown, letters = _tags.sub(" ", answer) if "<" in answer or "&" in answer else answer, 0
    for word in _words.finditer(shown):
        letters += len(word[0])
        if letters > MOST_FILLED:  # no filler has so many
            return False
    words = _words.findall(folded(shown))
    return not words or " ".join(words) in FILLERS


# Fixed values, without accents: what may stand around a repeated question.
FRAMES = {""} | {
    x.replace(" ", "") for x in """
    cau hoi|noi dung cau hoi|ban hoi|anh chi hoi|khach hoi|khach hang hoi|hoi|tra loi|cau tra loi|dap an|ve cau hoi|voi cau hoi|ve viec|lien quan den|question|your question|you asked|you ask|q|a|answer|re|quote|cua ban|cua quy khach|nhu sau|la|da|thua|vang|a|ad oi|xin hoi|cho minh hoi|cho toi hoi|cho hoi|hoi nhanh|shop oi|em oi|alo|xin chao|chao ban|mong phan hoi|cam on|cam on ban|thanks|thank you|hello|hi|please|quick question|nhe|voi|giup minh|giup toi
    """.strip().split("|")
}


def is_copy(q: list[str], a: list[str]) -> bool:
    """Whether the answer's words say the question's, once or more, framed or spelled differently, and nothing else."""
    one, other = "".join(q), "".join(a)
    if len(q) < 3 or len(other) < 0.6 * len(one):
        return False
    taken = False
    while (at := other.find(one)) >= 0:
        if other[:at] not in FRAMES:
            return False
        other, taken = other[at + len(one) :], True
    if taken:
        return other in FRAMES
    # Edited since: nearly all words of one are in the other, in order, about as often as it is repeated
    words = set(q)
    have = Counter(a)
    if sum(n for w, n in have.items() if w in words) < 0.85 * len(a) or sum(w in have for w in words) < 0.8 * len(words):
        return False
    times = max(1, round(len(a) / len(q)))
    aligned = sum(m.size for m in SequenceMatcher(None, q * times, a, autojunk=False).get_matching_blocks())
    return aligned >= 0.7 * len(a) and aligned >= 0.7 * times * len(q) and not _asked_on.search(" ".join(a))


_asked_on = re.compile(r"\b(?:ban xem o day|xem o day|see here|voici)\b")

# Fixed values, by language, without accents: ways to decline.
REFUSALS = {
    "vi": r"khong the (?:tra loi|giai dap|ho tro|giup|cung cap|huong dan|dap ung|tu van|thuc hien yeu cau)|khong (?:du|co) (?:du lieu|thong tin|cau tra loi|quyen)|chua (?:co|du) (?:thong tin|du lieu|cau tra loi)|khong tim thay (?:cau tra loi|thong tin|noi dung|ket qua)|ngoai pham vi|khong thuoc pham vi|toi khong (?:biet|ro|chac)|khong duoc phep (?:tra loi|cung cap|tu van)|(?:xin(?: phep)?|phai|toi|minh|buoc phai) tu choi|tu choi tra loi|xin phep khong tra loi|khong ho tro (?:duoc )?(?:yeu cau|cau hoi|noi dung)|khong dua ra y kien|khong (?:giai dap|tra loi) duoc|vi pham nguyen tac|la (?:mot )?(?:mo hinh|tro ly) (?:ngon ngu|ai|ao)",
    "en": r"\b(?:can ?not|can t|cant|could not|couldn t|unable to|not able to|won t|will not) (?:help|answer|assist|advise|comply|provide|respond|reply|discuss|support|share|give)|no answer (?:is|was) (?:available|found)|(?:do not|don t) (?:have|know) (?:an answer|any information|enough information|the answer|enough data|information|about|how)|as an ai|as a language model|outside (?:of )?(?:my|the|our) scope|outside what (?:i|we) can|beyond what (?:i|we) can|against (?:my|our) (?:rules|policy|guidelines)|out of (?:my|the) scope|must decline|have to decline|no information (?:is|on|about)",
    "fr": r"ne (?:peux|puis|pouvons) pas (?:repondre|aider|vous aider|vous repondre|donner|fournir)|pas (?:d information|de reponse|en mesure)",
    "de": r"kann (?:ich )?(?:ihnen )?(?:leider |nicht |diese |dabei )*(?:nicht )?(?:beantworten|helfen|weiterhelfen)|keine (?:antwort|information)",
    "ru": r"не (?:могу|можем) (?:помочь|ответить|предоставить)|нет (?:ответа|информации|данных)|к сожалению",
    "es": r"no (?:puedo|podemos) (?:responder|contestar|ayudar|ayudarle|ayudarte|proporcionar|ofrecer)|no (?:tengo|tenemos|dispongo de) (?:informacion|respuesta|datos)|no (?:se|conozco) la respuesta",
    "pt": r"nao (?:posso|podemos|consigo) (?:responder|ajudar|fornecer)|nao (?:tenho|temos) (?:informac|resposta|dados)",
    "it": r"non (?:posso|possiamo) (?:rispondere|aiutar|fornire)|non (?:ho|abbiamo) (?:informazioni|una risposta|risposte|dati)",
    "id": r"tidak (?:dapat|bisa) (?:menjawab|membantu|memberikan)|tidak (?:memiliki|punya) (?:informasi|jawaban)",
    "zh": r"(?:无法|不能|無法)(?:回答|提供|帮助|幫助|解答|回复|回覆)|没有(?:相关)?(?:信息|答案)|沒有(?:相關)?(?:資訊|答案)|我不知道",
    "ja": r"(?:お)?答え(?:する)?(?:こと)?(?:は|が)?(?:でき|致しかね)|お答えできません|回答(?:する)?(?:こと)?(?:は|が)?(?:できません|でき|致しかね)|わかりません|情報(?:は|が)(?:ありません|ございません)",
    "ko": r"답변(?:해 ?드릴|드릴|할)? ?수 ?(?:가 )?없|도와 ?드릴 수 없|정보가 없|알 수 없습니다",
    "th": r"ไม่สามารถ(?:ตอบ|ช่วย|ให้)|ไม่มี(?:ข้อมูล|คําตอบ|คำตอบ)|ไม่ทราบ",
}
# Thai marks and kana or Hangul parts that fall away with the accents do so here too
_refusals = re.compile("|".join(folded(x) for x in REFUSALS.values()))
# Fixed values, by language, without accents: how a line on where else to ask begins.
_redirect = re.compile(
    r"^(?:ban|quy khach|anh chi|vui long|xin|hay|moi ban|please|you|try|contact|ask|write|reach|call|see|vous|sie|bitte|veuillez|обрат|попроб|пожал|напиш|thanh that|rat tiec|xin loi|mong|sorry|i m sorry|we apologi|cam on|thanks|for help|de duoc ho tro|neu can|hotline|tong dai|email|website|fanpage|chi nhanh|branch|phone|dien thoai"
    + folded(r"|lo siento|por favor|contacte|desculpe|mi dispiace|per favore|contatti|maaf|silakan|hubungi|请|請|抱歉|对不起|對不起|很抱歉|申し訳|恐れ入り|すみません|お問い合わせ|죄송|문의|고객|ขออภัย|กรุณา|โปรด)")
)
_phone = re.compile(r"\b(?:0\d|84|1[89]00)[\d ]{4,}\b(?! ?(?:dong|vnd|d)\b)")
# What a line of where else to ask speaks of.
_elsewhere = re.compile(r"\b(?:lien he|hoi|goi|hotline|tong dai|chi nhanh|quay|nhan vien|ho tro|tro giup|cham soc|email|chat|fanpage|website|phone|dien thoai|tu van|contact|ask|call|write|reach|visit|support|help|branch|desk|counters?|office|team|cent(?:er|re)|guichet|schalter|trung tam|bo phan|van phong|staff|agent|hot ?line|contactez|appelez|ecrivez|agence|conseiller|wenden|kontakt\w*|filiale|обрат\w*|звон\w*|напиш\w*|служб\w*|поддержк\w*)\b")
# What says how to do it, and so answers.
_does = re.compile(r"\b(?:vao|chon|bam|nhap|mo|nhan nut|quet|dien|open|press|select|choose|enter|tap|click|scan|fill|ouvrez|appuyez|choisissez|offnen|wahlen|drucken|откройте|нажмите|выберите|введите)\b")
_sentence = re.compile(r"(?:[^.!?…;\n。！？]|[.!?…;](?!\s|$))+[.!?…;。！？]*")
_figures = re.compile(r"\d{3}")


def is_refusal(answer: str) -> bool:
    """Whether the answer declines, and at most says where else to ask; read up to the first sentence that does neither."""
    declined = False
    for sentence in _sentence.finditer(answer):
        plain = " ".join(_words.findall(folded(sentence[0])))
        if not plain:
            continue
        if _refusals.search(plain):
            declined = True
        elif not _redirect.match(plain) or _figures.search(_phone.sub(" ", plain)) or _does.search(plain) and not _elsewhere.search(plain):
            return False
    return declined


# Frequent words by language (Vietnamese without accents).
COMMON = {
    "vi": "khong duoc ngan hang ban cua thi va neu trong khi cho voi mot cac nhung qua la bi boi tai tren toi den tu sau truoc ngay gio phut dong lenh giao dich tien khoan the ma loi mo vao muc bam chon nhap han muc phi thoi gian rieng xem bien lai nguoi khach yeu cau so buoc cach kiem tra muon thanh toan chuyen rut nap dang ky van tay dien thoai phai cach hoac vi sao lam nao gi dau bao nhieu nay do se da dung cung theo lai hoi quy vi nhan gui".split(),
    "en": "the of to and is in for on with you your be if at by from as this that will are it an or not can was has have we they please what how when which why after before under before open press enter check bank order card account payment fee limit time minutes hours day through using may need sent because see also code".split(),
    "fr": "le la les des une du et est pour vous votre dans sur avec par que qui au aux ne pas de en un ou si sera jusqu par chez avant apres banque montant ordre carte compte depuis peut jour heures delai erreur signifie ecrivez verifiez dabord citant plus tot tard aupres".split(),
    "de": "der die das und ist nicht ein eine zu den mit von fur im auf dem sie ihr ihre wird wurde kann konnen bei nach vor aus bis uber wenn weil dann stunden tage betrag bank auftrag fehler konto karte zuerst prufen schreiben bearbeitung dauert ab pro tag erscheint nachsten".split(),
}
WEIGHTS = {language: set(words) for language, words in COMMON.items()}
_marked = re.compile("[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉĩịọỏốồổỗộớờởỡợụủũứừửữựỳỵỷỹ]")
_german = re.compile("[äöüß]")
_french = re.compile("[çœëï]|qu'|l'|d'|j'")
_quoted = re.compile(r'"[^"\n]{0,60}"')
_digit = re.compile(r"\d")
_letters = re.compile(r"[^\W\d_]+")
_unlatin = re.compile("[^\\W\\d_a-zA-ZªºÀ-ʯḀ-ỿ]")


@lru_cache(1 << 17)
def _word(word: str) -> tuple[tuple[str, float], ...]:
    """What a word says of the language that it stands in."""
    plain = folded(word)
    points = Counter({name: 1.0 for name, common in WEIGHTS.items() if plain in common})
    points["vi"] += 1.5 * bool(_marked.search(word))
    points["de"] += 1.5 * bool(_german.search(word))
    return tuple((name, p) for name, p in points.items() if p)


def _read(text: str) -> tuple[str, list[str], list[str]]:
    """Lower case without links, quotations and what has a digit, which belong to no language; its words, and its letters that aren't Latin."""
    text = text.lower()
    if '"' in text:
        text = _quoted.sub(" ", text)
    parts = text.split()
    read = " ".join([x for x in parts if x.isalpha() or not (_digit.search(x) or "http" in x)])
    return read, _letters.findall(read), [] if read.isascii() else _unlatin.findall(read)


def language(read: str, words: list[str], foreign: list[str]) -> str | None:
    """The language that a text, as ``_read``, is written in; None where it says too little."""
    if not words:
        return None
    if len(foreign) > 0.5 * (letters := sum(map(len, words))):
        return "ru" if letters >= 8 and sum("Ѐ" <= c <= "ӿ" for c in foreign) > 0.5 * letters else None
    score: Counter[str] = Counter()
    for said in map(_word, words):
        for name, points in said:
            score[name] += points
    if not read.isascii() or "'" in read:
        score["fr"] += 0.5 * len(_french.findall(read))
    (best, most), *others = score.most_common() or [("", 0)]
    second = others[0][1] if others else 0
    return best if most >= 3 and most >= 0.12 * len(words) and most >= 1.25 * second else None


@lru_cache(1 << 16)
def _script(letter: str) -> str:
    """The script of a letter by its name; Han and kana are one, since Japanese mixes them."""
    name = unicodedata.name(letter, "?").split(" ")[0].split("-")[0]
    return "CJK" if name in ("HIRAGANA", "KATAKANA") else name


def main_script(words: list[str], foreign: list[str], least: int) -> str | None:
    """The script of more than half of the letters; None for fewer than ``least`` Latin words, which may be names."""
    if not foreign:
        return "LATIN" if len(words) >= least else None
    count = Counter({"LATIN": sum(map(len, words)) - len(foreign)})
    for c, n in Counter(foreign).items():
        count[_script(c)] += n
    (script, most), *_ = count.most_common(1)
    if 2 * most <= count.total() or script == "LATIN" and len(words) < least:
        return None
    return script


def is_other_language(question: str, answer: str) -> bool:
    """Whether the scripts differ, or within one script the languages."""
    question, answer = _read(question), _read(answer)
    asked, told = main_script(*question[1:], 2), main_script(*answer[1:], 3)
    if asked and told and asked != told:
        return True
    found = language(*answer)
    return found is not None and (own := language(*question)) is not None and own != found


_item = re.compile(r"^\s*(?:[-–•*👉✅▪➤]\s|\(?\d{1,3}[.)]\s|[A-Za-z]{1,3}\d{1,3}\s?[-:.)]|\(?[A-Za-z]\)\s|\w{2,6}\s\d{1,3}\s?[-:)]\s)", re.U)
_joined = re.compile(r"\n|(?<!\s)\s{2,}(?=(?:[-–•*]\s|\(?\d{1,3}[.)]\s|B\d+ ?-|\w{2,6} \d{1,3} ?:))")
_stop = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_announced = re.compile(r"\b(\d{1,2})\s+(?:buoc|viec|muc|cach|giay to|dieu|y|steps?|items?|points?|things|ways?|papers?|documents?)\b[^.\n:]{0,40}:\s*$", re.M)
# Words that can't be the last of a sentence; for Vietnamese without accents only those that no other word falls together with.
OPEN_WORDS = set(
    "và hoặc với của cho để nếu thì mà khi vì do nên những là các một trong trên tại ở từ đến tới qua bằng theo về sẽ phải riêng kể cả kèm sang giữa".split()
    + "va hoac voi cua neu thi khi cac nhung tai bang".split()
    + "the a an of to and or with for if when because that which from by at is are was be will must your our their than as into until while may".split()
    + "le la les des une du et ou pour dans sur avec par que qui aux en si der die das und oder mit von zu den dem ein eine im auf bei nach wenn weil".split()
    + "и или в на с по для из от до за под при что если когда через".split()
)
_last_word = re.compile(r"([^\W\d_]+)\W*$")


def _lines(text: str) -> list[str]:
    return [x.strip() for x in _joined.split(text) if x.strip()]


_open = re.compile(r"(?:[:,;(\[{–]|\s-|[\"“«]\s*)$")
_closed_quote = re.compile(r"\S\"$")
_bracket = re.compile(r"\([^()\n]*$")
_link = re.compile(r"(?:https?://|www\.)\S+$")
_particle = re.compile(r"[?!.]\s*(?:ạ|a|nhé|nhe|ha|nha)$")
_inner_stop = re.compile(r"[.!?…]\s+\S")
_unbroken = re.compile(r"\S{25}$")


def is_unclosed(text: str, lines: list[str], plain: str) -> bool:
    """Whether a bracket, quotation or announced list is still open at the end."""
    if ":" in plain:
        for m in _announced.finditer(plain):
            rest = [x for x in _joined.split(text[m.end() :] if len(plain) == len(text) else plain[m.end() :]) if x.strip()]
            if sum(1 for x in rest if _item.match(x)) < int(m[1]):
                return True
    last = lines[-1]
    if _open.search(last) and not _closed_quote.search(last):
        return True
    return bool(_bracket.search(last)) or last.count('"') % 2 == 1 and not _stop.search(last)


def is_abrupt(lines: list[str]) -> bool:
    """Whether the last line stops inside a word, a sentence or a list."""
    last = lines[-1]
    if _stop.search(last) or _link.search(last) or _particle.search(last):
        return False
    word = _last_word.search(last.lower())
    if word and last.lower().endswith(word[1]) and word[1] in OPEN_WORDS and not last.endswith(word[1].title()):
        return True
    if _item.match(last):
        before = [x for x in lines[:-1] if _item.match(x)]
        stopped = sum(1 for x in before if _stop.search(x))
        return len(before) >= 1 and stopped > 0.5 * len(before)
    return bool(_inner_stop.search(last)) or len(lines) > 1 and bool(_stop.search(lines[-2])) and len(last) > 20 or not _unbroken.search(last) and len(last) > 120


def found_kinds(question: str | None, answer: str | None) -> list[str]:
    """All kinds of defect of a pair, in the order of the rules."""
    if is_empty(answer):
        return ["empty_answer"]
    a, q = consistent(answer), consistent(question)
    if a is not answer and is_empty(a):
        return ["empty_answer"]
    text = a.rstrip()
    lines, plain, asked = _lines(text), folded(text), not is_empty(q)
    found = []
    if is_unclosed(text, lines, plain) or is_abrupt(lines):
        found.append("truncated_answer")
    if is_refusal(a):
        found.append("refusal")
    if asked and is_copy(_words.findall(folded(q)), _words.findall(plain)):
        found.append("copied_question")
    if asked and is_other_language(q, a):
        found.append("other_language")
    return found


def defects(question: str | None, answer: str | None) -> list[str]:
    """All kinds of defect of a pair, in the order of KINDS."""
    return sorted(found_kinds(question, answer), key=KINDS.index)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            found = [defects(q, a) for q, a in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.string()))], names=["key", "defects"])


def flagged(df: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """(``key``, defects, defect) of every pair: all kinds found and the first, null where there's none. A narrow pass."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("defects", T.ArrayType(T.StringType()))])
    done = df.select(key, question, answer).mapInArrow(_rows, schema)
    return done.select(F.col("key").alias(key), "defects", F.try_element_at("defects", F.lit(1)).alias("defect"))
