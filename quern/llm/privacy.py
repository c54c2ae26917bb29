"""Personal information in free text (queries p1_).

A chain of transducers rewrites a text and keeps, for each character it writes,
the span of the source it stands for: (1) width, accents, characters that show
nothing and look-alike letters become plain letters; (2) spelled digits become
digits; (3) the disguises of "at" and "dot" become @ and a full stop; (4) the
letter o or l between digits becomes 0 or 1. Identifiers are detected on the
result and their spans mapped back, so the placeholder replaces just the source
characters and the rest of the sentence stays as it was.

Defined results: null stays null and has no findings; empty and blank texts have
none; of overlapping findings the first kind of ``KINDS`` counts; very long texts are taken whole; repeated rows give equal rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.forms import INVISIBLE, LATIN_OF

KINDS = ("email", "id_number", "phone", "address", "name")


class Tape:
    """A rewritten text with the source span of each of its characters."""

    __slots__ = ("text", "low", "high", "words")

    def __init__(self, text: str, low: list[int] | range, high: list[int] | range):
        self.text, self.low, self.high = text, low, high
        self.words: set[str] = set()  # in small letters, before digits and signs are rewritten

    def rewrite(self, pattern: re.Pattern, replace: Callable[[re.Match], list[tuple[str, int, int]] | None]) -> Tape:
        """Put, for each match, (character, start, end) items of this tape; None leaves it."""
        text, low, high, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            items = replace(m)
            if items is None:
                continue
            text.append(self.text[at : m.start()])
            low += self.low[at : m.start()]
            high += self.high[at : m.start()]
            for c, a, b in items:
                text.append(c)
                low.append(self.low[a])
                high.append(self.high[b - 1])
            at = m.end()
        if not text:
            return self
        return Tape("".join([*text, self.text[at:]]), [*low, *self.low[at:]], [*high, *self.high[at:]])

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.low[start], self.high[end - 1]


class _Plain(dict):
    """Characters to plain ones, of their own number."""

    def __missing__(self, c: int) -> str:
        parts = unicodedata.normalize("NFKD", chr(c)).replace("đ", "d").replace("Đ", "D")
        plain = "".join(LATIN_OF.get(ord(x), x) for x in parts if not unicodedata.combining(x))
        if unicodedata.category(chr(c)) == "Zs":
            plain = " "
        self[c] = "" if chr(c) in _hidden else plain
        return self[c]


_hidden = {c for part in re.findall("(.)-(.)|(.)", INVISIBLE) for c in (map(chr, range(ord(part[0]), ord(part[1]) + 1)) if part[0] else part[2])}
_plain = _Plain()


#: Characters that are known to have one plain character.
_single: set[str] = set()


def plain_tape(text: str) -> Tape:
    out = text if text.isascii() else text.translate(_plain)
    if out is text or len(out) == len(text) and ((used := set(text)) <= _single or all(len(_plain[ord(c)]) == 1 for c in used)):
        if out is not text and len(_single) < 100_000:
            _single.update(used)
        return Tape(out, range(len(text)), range(1, len(text) + 1))
    chars, low, high = [], [], []
    for i, c in enumerate(text):
        written = _plain[ord(c)]
        if written:
            chars.append(written)
            low += [i] * len(written)
            high += [i + 1] * len(written)
        elif high:
            high[-1] = i + 1  # an accent belongs to the letter before it
    return Tape("".join(chars), low, high)


# Digits spelled in Vietnamese (without accents) and English.
DIGITS = {
    "khong": "0", "linh": "0", "mot": "1", "hai": "2", "ba": "3", "bon": "4", "tu": "4", "nam": "5", "lam": "5", "sau": "6", "bay": "7", "bẩy": "7", "tam": "8", "chin": "9",
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_digit = "|".join(sorted(DIGITS, key=len, reverse=True))
_spelled = re.compile(rf"(?i)(?<!\w)(?:{_digit}|\d)(?:[ ,.\-]{{1,3}}(?:{_digit}|\d)(?!\w)){{6,}}")
_element = re.compile(r"(?i)[a-z]+|\d")
_tld = r"(?:com|net|org|vn|edu|gov|info|io|co|biz|me|fr|de|ru|uk|us|eu)"
_dotted = r"(?:\.|\s*[(\[{]\s*(?:dot|cham|\.)\s*[)\]}]\s*|\s+(?:dot|cham)\s+)"
_bare_at = re.compile(rf"(?i)(?<=[a-z0-9_+\-])\s+at\s+(?=[a-z0-9\-]+(?:{_dotted}[a-z0-9\-]+)*{_dotted}{_tld}\b)")
_at = re.compile(r"(?i)(?<=[a-z0-9_+\-])(?:\s*[(\[{<]\s*(?:at|a cong|a-cong|acong|a moc|@)\s*[)\]}>]\s*|\s+(?:a cong|a-cong|acong|a moc)\s+|\s+@\s+)(?=[a-z0-9])")
_dot = re.compile(r"(?i)(?<=[a-z0-9])(?:\s*[(\[{]\s*(?:dot|cham|\.)\s*[)\]}]\s*|\s+(?:dot|cham)\s+)(?=[a-z0-9])")
_letters = re.compile(r"(?i)(?<![a-z\d])(?=(?:[ol .\-]{0,3}\d){6})[\dol](?:[ .\-]?[\dol]){7,13}(?![a-z\d])")


def _digits(m: re.Match) -> list[tuple[str, int, int]] | None:
    words = list(_element.finditer(m[0]))
    if sum(1 for w in words if not w[0].isdigit()) < 3:
        return None
    return [(DIGITS.get(w[0].lower(), w[0]), m.start() + w.start(), m.start() + w.end()) for w in words]


def _zeros(m: re.Match) -> list[tuple[str, int, int]] | None:
    if m[0].isdigit() or not re.search("(?i)[ol]", m[0]):
        return None
    return [({"o": "0", "l": "1"}.get(c.lower(), c), m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0])]


_domain = re.compile(r"(?i)@[a-z0-9\-]*(?:(?:\.|\s*[(\[{]\s*(?:dot|cham|\.)\s*[)\]}]\s*|\s+(?:dot|cham)\s+)[a-z0-9\-]+)*$")


def _full_stop(m: re.Match, tape: Tape, source: str) -> list[tuple[str, int, int]] | None:
    """A full stop in the domain of an address, or where the word for it is written out exactly."""
    own = unicodedata.normalize("NFC", source[slice(*tape.source(m.start(), m.end()))]).lower().strip(" ()[]{}")
    if "\n" in m[0] or own not in ("chấm", "cham", "dot", ".") or not _domain.search(m.string[max(0, m.start() - 80) : m.start()]) and own != "chấm":
        return None
    return [(".", m.start(), m.end())]


def normal(text: str) -> Tape:
    """The four transducers in a row; each runs where the text has what it rewrites."""
    tape = plain_tape(text)
    low = tape.text.lower()
    found = _letter_words.findall(low)
    words = set(found)
    if not words.isdisjoint(DIGITS) and sum(map(DIGITS.__contains__, found)) >= 3:
        tape = tape.rewrite(_spelled, _digits)
    if "at" in low or "cong" in low or "moc" in low or "@" in low:
        tape = tape.rewrite(_at, lambda m: [("@", m.start(), m.end())])
        if " at " in low:
            tape = tape.rewrite(_bare_at, lambda m: [("@", m.start(), m.end())])
    if "@" in tape.text:
        tape = tape.rewrite(_dot, lambda m: _full_stop(m, tape, text))
    if len(_any_digit.findall(tape.text)) >= 6:
        tape = tape.rewrite(_letters, _zeros)
    tape.words = words
    return tape


_letter_words, _any_digit = re.compile("[a-z]+"), re.compile(r"\d")

Found = tuple[int, int, str]

_email = re.compile(r"(?i)(?<![a-z0-9._%+\-@])[a-z0-9][a-z0-9._%+\-]*@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+(?<![.\-])")
_url = re.compile(r"(?i)\b(?:https?://|www\.)\S+")

# Fixed values, without accents: labels of identity numbers.
_id = re.compile(
    r"(?i)(?<!\w)(?:ssn|social security(?: number| no)?|cccd|can cuoc(?: cong dan)?|cmnd|cmt(?:nd)?|chung minh(?: thu| nhan dan)?|so dinh danh|dinh danh(?: ca nhan)?|ho chieu|hc|passport|pp|national id(?: card)?|citizen(?:ship)? (?:card|id)|identity (?:card|number)|(?:old )?id(?: card)?"
    r"|mst|ma so thue|tax (?:number|code|id|no)|gplx|giay phep lai xe|bang lai(?: xe)?|driv(?:ing|er'?s?) licen[cs]e|licen[cs]e)"
    r"(?:[ \t]*(?:ca nhan|gan chip|xe|hang \w\d?|so|no|number|num|moi|cu|cua (?:toi|minh|em|anh|chi)|toi|minh|la|is|[:#.\-]))*[ \t]*"
    r"(?P<value>(?:[a-z]{1,2}[ \-]?)?\d(?:[ .\-]?\d){6,13})(?![\d/]|[a-z]|[ ]?(?:dong|vnd|vnđ|usd|credits|trieu)\b)"
)
#: Words of which every label has one.
ID_WORDS = set("ssn social cccd can cmnd cmt cmtnd chung dinh ho hc passport pp national citizen citizenship identity id mst ma tax gplx giay bang driving driver drivers license licence".split())
_bare_id = re.compile(r"(?<![\w/.\-])0\d{2}[ .\-]?\d{3}[ .\-]?\d{3}[ .\-]?\d{3}(?![\w/]|[.\-]\d)")
_number = re.compile(r"(?<![\w/\-.+])\(?\+?\(?\d(?:[ .\-()]{0,2}\d){6,15}(?![\d/:]|[a-z]\w)(?:\s*(?:ext|x|may le)\.?\s*\d{1,5}(?!\w))?", re.I)
# Fixed values, without accents: what makes the number after it another kind of number.
_other_number = re.compile(
    r"(?i)(?:\b(?:ma|so|number|no|id)?[ \t]*(?:giao dich|don(?: hang)?|hoa don|tai khoan|stk|tham chieu|tra soat|yeu cau|lenh|xac nhan|xac thuc|hop dong|the|bien lai|otp|pin|ma|transaction|order|account|invoice|bill|reference|ref|code|receipt|card|request|payment)|kenh|phien ban|version|build|loi|error)"
    r"(?:[ \t]*(?:number|no\.?|so|code|cua (?:minh|toi|em|khach)|la|is|was|[:#.]))*[ \t]*$"
)


_grouped = re.compile(r"(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}$")


def _phone_end(text: str) -> int:
    """Where a phone number that starts the text ends, at a separator; 0 for none."""
    digits = re.sub(r"\D", "", re.split(r"(?i)ext|x|may le", text)[0])
    plus = text.lstrip("(").startswith("+")
    local = re.sub(r"^(?:0084|84)", "0", digits) if digits.startswith(("84", "0084")) else digits
    if local.startswith("00") and digits.startswith(("84", "0084")):
        local = local[1:]
    if len(local) == 10 and local[0] == "0" and local[1] in "2356789" or len(local) == 11 and local[:2] == "02":
        return len(text)
    if not plus and len(digits) == 10 and digits[0] in "23456789" and _grouped.match(text):
        return len(text)
    if plus and not digits.startswith("84") and 8 <= len(digits) <= 15:
        return len(text)
    return 0


_cap = r"[A-Z][A-Za-z']*"
# Fixed values, without accents: words that begin a sentence and not a place's name.
_caps = rf"{_cap}(?:[ ](?!(?:Toi|Minh|Buoc|Nho|To|Duong|The|Ma|So|Hoa|Ung|Em|Anh|Chi|Khach|Lien|Tra|Mail|Day|Gui|Dien|Ho|The|Step|Card|My|I)[ ][a-z]){_cap}){{0,3}}"
_house = r"\d{1,4}[A-Za-z]?(?:[/\-]\d{1,4}[A-Za-z]?){0,4}"
_area = rf"(?:[ ]?[,\-–][ ]?(?:(?i:phuong|quan|xa|huyen|thi tran|thi xa|thanh pho|tinh|tp\.?|p\.|q\.|khu pho|kp|to|duong|pho|chung cu|toa|tang|ap|thon|ngo|ngach|hem)[ ]?)?(?:{_caps}|\d{{1,3}}[A-Za-z]?(?![\d:/])))"
_address = re.compile(
    r"(?<![\w/])(?:"
    rf"(?:(?i:so nha|nha so|nha|so|lo)[ ])?{_house},?[ ](?:(?i:ngo|ngach|hem|kiet)[ ]{_house},?[ ])?(?i:duong|pho|ngo|ngach|hem|quoc lo|tinh lo|dai lo|khu pho)[ ](?!(?i:truyen|dan|link|day)\b)(?:{_house}[ ])?{_caps}"
    rf"|(?i:so nha|nha so|so|nha|hem|ngo|ngach|kiet|lo)[ ]{_house},?[ ](?:(?i:to|khu pho|kp|ngo|ngach|hem|pho|duong|ap)[ ](?:\d{{1,3}},?[ ])?)?{_caps}(?=[ ]?[,\-–]|\W*$|[ ](?i:khu|phuong|quan|xa|p\.|q\.|tp))"
    rf"|(?i:can ho|can|phong|toa|block)[ ][A-Za-z]?{_house},?[ ](?:(?i:tang[ ]\d+,?[ ])?(?i:chung cu|toa|toa nha|khu do thi|kdt)[ ])?{_caps}"
    rf"|(?i:thon|xom|ap|buon|lang|to dan pho)[ ](?:\d{{1,3}}|{_caps})[ ]?[,\-–][ ]?(?i:xa|phuong|huyen|thi tran|quan|tinh)[ ]{_caps}"
    rf"|(?:(?i:flat|apartment|apt|unit|house|no)\.?[ ]{_house},?[ ])?{_house}[ ]{_cap}(?:[ ]{_cap}){{0,3}}[ ](?i:street|st|lane|road|rd|avenue|ave|close|way|drive|court|terrace|crescent)\b"
    rf"){_area}*"
)

# Vietnamese surnames.
SURNAMES = set(
    "nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đào đoàn vương trịnh đinh lâm phùng mai tô hà tạ lưu chu châu thái tống thạch quách mạc nghiêm la kiều từ hứa diệp cao lương trương triệu phí giang ninh doãn khổng bạch lại viên thân cù kim ông văn mạch".split()
)
# Syllables of Vietnamese middle and given names.
GIVEN = set(
    "an anh ánh ân bách bảo bích bình bội ca cẩm cát châu chi chàm chiến công cúc cường dao dân diễm diên diệu dũng dung duy duyên dương đài đan đào đăng đạt điền đình định đông đức đoan gia giang giao hà hạ hải hạnh hân hằng hậu hiền hiển hiếu hiệp hoa hoà hoài hoàn hồng hùng huệ huy huyền hưng hương hường hữu kha khải khang khánh khiêm khoa khôi khuê kiên kiệt kim kỳ lạc lam lan lâm lệ liên linh lĩnh loan lộc long luân lưu lựu lương ly mai mạnh mận mẫn mây mi mịch minh mộng mỹ my nam nga ngà ngải ngàn ngân nghi nghĩa ngọc nguyên nguyệt nhã nhàn nhân nhật nhi nhiên nhu nhung như ninh oanh phát phi phong phú phúc phụng phước phương phượng quân quang quế quốc quy quyên quyền quyết quỳnh rạng sa san sang sậy sen sim sinh sơ sơn sương tài tâm tân thái thành thảo thắm thắng thanh thế thi thịnh thoa thông thơ thới thu thuận thuần thuỳ thuý thuỷ thuỵ thư thương tiên tiến tịnh toàn trà trác tràm trang trâm trân trí trinh trọng trúc trung tú tuấn tuệ tùng tuy tuyền tuyết tường uyên ước vân văn vi viên việt vinh vỹ vy xuân yên yến hoạ huế thủy thúy hòa họa thụy thùy".split()
)
# Surnames that are hardly a common word, for names in small letters.
SMALL_SURNAMES = set("nguyễn trần lê phạm hoàng huỳnh phan vũ võ đặng bùi đỗ hồ ngô dương lý đoàn trịnh đinh phùng tạ lưu tống thạch quách mạc nghiêm trương triệu".split())
TITLES = set("anh chị cô chú bác ông bà em dì cậu thím mợ".split())


def _without(words: set[str]) -> set[str]:
    return {w.translate(_plain).lower() for w in words}


PLAIN_SURNAMES, PLAIN_GIVEN, PLAIN_TITLES = _without(SURNAMES), _without(GIVEN), _without(TITLES)
PLAIN_SMALL = _without(SMALL_SURNAMES)
PLAIN_STARTS = PLAIN_SURNAMES | PLAIN_TITLES
BARE_TITLES = set("anh chi co chu bac ong ba".split())
# Fixed values, without accents: what stands before the name of a thing or a place.
_thing = re.compile(
    r"(?i)(?:\b(?:ngan hang|the|vi|goi|quy|so|kenh|may|dong ho|ung dung|dich vu|cong|tai khoan|bao hiem|ma qr|qr|tra sau|phuong|xa|quan|huyen|thon|tp|thanh pho|tinh|duong|pho|ngo|hem|chung cu|toa nha|trinh duyet|app|muc|nut|hang|san pham|chuong trinh|khu vuc|chi nhanh|bank|card)|\b[pq]\.)[ ]*[\"“]?$"
)
_token = re.compile(r"[A-Za-z]+(?:['\-][A-Za-z]+)*")
# What introduces a person; verbs of what persons do, with their irregular pasts; adverbs before them; what is no name in small letters.
INTRODUCTIONS = "my name is|name is|full name|name|this is|i am|i'm|contact person is|contact person|contact is|contact|call|reach|ask for|speak to|speak with|signed by|signed|named as|named|dear|hello|hi|hey|customer|client|on behalf of|attention|attn|mr|mrs|ms|miss|dr".split("|")
CLOSINGS = "regards|thanks|thank you|sincerely|best|cheers|yours".split("|")
DOES = "want ask call report live prefer use like own claim travel visit complain request explain try love hate plan shop hope wish owe earn move study register enjoy remember order return arrive phone mention apologise apologize work".split()
DID = "says said loses lost writes wrote pays paid speaks spoke sends sent buys bought forgets forgot tells told thinks thought knows knew keeps kept spends spent".split()
ADVERBS = "often usually always rarely never sometimes also just already still recently seldom hardly normally generally frequently".split()
COMMON_WORDS = set(
    "known done made given taken seen the and for not but you your our his her its are was were has had have with from that this these those there here what when where which who why how can could will would should must may might about into onto over under after before again also very too just still only even ever never always often usually really sure some any all each every many much more most few other another same such own new old good bad great best first last next right wrong please thanks thank hello dear sorry yes sir madam team support service customer client user bank card account wallet app plan fund order payment gateway portal insurance voucher money balance code number name phone email address urgent important wrong fine happy unable able ready back home office branch help contact call reach ask using trying calling writing getting going being having making waiting asking looking".split()
) | set(ADVERBS)
THINGS = re.compile(r"(?i)\b(?:bank|card|cards|account|wallet|app|plan|fund|order|payment|gateway|portal|insurance|voucher|support|service|customer|team|the|not|how|why|about|still|what|urgent|pay|lite|plus|pro|max|mini|tablet|phone|watch|savings|loan|visa|mastercard|napas|platinum|gold|debit|credit)\b")


def _verbs() -> list[str]:
    """The third persons and pasts of DOES by rule, and DID."""
    forms = list(DID)
    for v in DOES:
        stem = v[:-1] + "i" if v.endswith("y") and v[-2] not in "aeou" else v
        forms += [stem + ("es" if stem != v or v[-1] in "shx" else "s"), stem + ("d" if v[-1] == "e" else "ed")]
    return forms


VERBS = _verbs()

_part = r"[A-Z][A-Za-z]*(?:['\-][A-Za-z]+)*"
_small = r"[a-z]{3,}(?:['\-][a-z]+)?"
_act = rf"(?= (?:(?:{'|'.join(ADVERBS)}|[a-z]+ly) )?(?:{'|'.join(VERBS)})\b)"
_introduced = rf"(?i:\b(?:{'|'.join(INTRODUCTIONS)})[.:]?)[ ]+|(?i:\b(?:{'|'.join(CLOSINGS)}),?)[ ]*\n+[ ]*"
#: A name is a few words of its shape where a person is introduced or acts; what a sentence says of the person doesn't matter.
NAMED = [
    re.compile(rf"(?:{_introduced})(?P<value>{_part}(?:,? (?!I\b){_part}){{1,3}})(?!\w)"),
    re.compile(rf'(?<![\w,"])(?P<value>{_part}(?:,? (?!I\b){_part}){{1,3}}){_act}'),
]
SMALL_NAMED = [
    re.compile(rf"(?i:\b(?:{'|'.join(x for x in INTRODUCTIONS if x not in ('hi', 'hey', 'hello', 'i am', 'name'))})[.:]?) (?P<value>{_small}(?:,? {_small}){{1,2}}?)(?=[,.;!?\n]|$| (?:at|on|and|from|or|who|to) |{_act[3:-1]})"),
    re.compile(rf"(?:^|[.!?\n]\s*)(?P<value>{_small}(?:,? {_small}){{1,2}}?){_act}"),
]
#: Words of which one stands before or after a name in these contexts: of an introduction the last that isn't frequent.
_contexts = {[w for w in re.findall("[a-z]+", x) if w not in ("is", "for", "to", "with", "by", "as", "i", "of", "on", "you")][-1] for x in (*INTRODUCTIONS, *CLOSINGS)} | set(VERBS)
_shaped = re.compile(r"(?:ed|ing|ly|tion|sion|ment|ness|able|ible|ous|ful|ity)$")


def _foreign_names(text: str, words: set[str]) -> Iterator[Found]:
    """Names that no list has, by their shape in the context of a person."""
    if words.isdisjoint(_contexts):
        return
    for pattern in NAMED:
        for m in pattern.finditer(text):
            if not THINGS.search(m["value"]):
                yield m.start("value"), m.end("value"), "name"
    for pattern in SMALL_NAMED:
        for m in pattern.finditer(text):
            parts = re.findall(r"[a-z'\-]+", m["value"])
            if not any(x in COMMON_WORDS or _shaped.search(x) for x in parts) and not THINGS.search(m["value"]) and not set(parts) & _contexts:
                yield m.start("value"), m.end("value"), "name"


# Fixed values, without accents: words of which every address has one.
ADDRESS_WORDS = set("duong pho ngo ngach hem quoc tinh dai khu so nha kiet lo can phong toa block thon xom ap buon lang to flat apartment apt unit house no street st lane road rd avenue ave close way drive court terrace crescent".split())
#: Markers of Vietnamese middle names, which make a name of what stands around them.
_marked_name = re.compile(r"(?<![\w'])[A-Z][a-z]{1,5} (?:Thi|Van|A) [A-Z][a-z]{1,6}(?: [A-Z][a-z]{1,6})?(?!\w)")
# Fixed values, without accents: what tells that a name follows it.
_told = re.compile(r"(?i)\b(?:ten(?: toi)?(?: la)?|khach(?: hang)?|toi la|minh la|em la|la|cho|chao|cua|ho ten|nguoi nhan|goi toi la|va|con|ghi ten|thu huong(?: quen)?)[: ]+$")
_not_names = {"ho so", "ly do", "luu y", "luu thay", "ta ve", "do la", "le phi", "ho tro", "tu choi", "cao cap", "la vi"}


def _names(tape: Tape, source: str) -> Iterator[Found]:
    text = tape.text
    yield from _foreign_names(text, tape.words)
    if " Thi " in text or " Van " in text or " A " in text:
        for m in _marked_name.finditer(text):
            own = source[slice(*tape.source(m.start(), m.end()))].split()
            marker = m[0].split()[1]
            if (marker != "A" or own[0] != m[0].split()[0]) and (marker != "Van" or own[1] == "Văn") and not _thing.search(text[max(0, m.start() - 24) : m.start()]):
                yield m.start(), m.end(), "name"
    if tape.words.isdisjoint(PLAIN_STARTS):
        return
    tokens = list(_token.finditer(text))
    words = [t[0].lower() for t in tokens]
    used = -1
    for i in [i for i, w in enumerate(words) if w in PLAIN_STARTS]:
        t = tokens[i]
        if i <= used:
            continue
        a, b = tape.source(t.start(), t.end())
        own = unicodedata.normalize("NFC", source[a:b]).lower()
        bare = own == words[i]
        surname, title = own in SURNAMES or bare and words[i] in PLAIN_SURNAMES, own in TITLES or bare and words[i] in BARE_TITLES
        if not surname and not title:
            continue
        following = []
        for j in range(i + 1, min(i + 5, len(tokens))):
            if text[tokens[j - 1].end() : tokens[j].start()] != " ":
                break
            following.append(j)
        before = text[max(0, t.start() - 24) : t.start()]
        capital = t[0][0].isupper()
        caps = []
        for j in following:
            if not tokens[j][0][0].isupper() or len(tokens[j][0]) < 2 and not words[j] in PLAIN_GIVEN:
                break
            caps.append(j)
        if surname and capital and caps:
            loud = t[0].isupper() and len(t[0]) > 1
            caps = [j for n, j in enumerate(caps) if all(tokens[x][0].isupper() == loud for x in caps[: n + 1])]
            prior = tokens[i - 1] if i and text[tokens[i - 1].end() : t.start()] == " " else None
            joined = prior is not None and prior[0][0].isupper() and words[i - 1] not in PLAIN_TITLES and words[i - 1] not in ("khach", "ten", "la", "hang", "customer", "chao", "da", "cho")
            if caps and any(words[j] in PLAIN_GIVEN for j in caps) and not joined and not _thing.search(before) and (len(caps) > 1 or f"{words[i]} {words[caps[0]]}" not in _not_names):
                yield t.start(), tokens[caps[-1]].end(), "name"
                used = caps[-1]
                continue
        if title and caps and (not bare or t[0].islower() or i == 0 or not text[max(0, t.start() - 3) : t.start()].rstrip()[-1:].isalnum()):
            good = []
            for j in caps:
                if words[j] not in PLAIN_GIVEN and words[j] not in PLAIN_SURNAMES or tokens[j][0].isupper() and len(tokens[j][0]) > 1 and not t[0].isupper() and len(caps) == 1 and words[j] not in PLAIN_GIVEN:
                    break
                good.append(j)
            if good and not (own == "em" and not bare):
                yield t.start(), tokens[good[-1]].end(), "name"
                used = good[-1]
                continue
        if (surname or title) and not capital and following:
            good = []
            for j in following:
                c, d = tape.source(tokens[j].start(), tokens[j].end())
                given = unicodedata.normalize("NFC", source[c:d]).lower()
                if tokens[j][0][0].isupper() or not (given in GIVEN or given in SURNAMES or given == words[j] and bare and words[j] in PLAIN_GIVEN):
                    break
                good.append(j)
            if not good or f"{words[i]} {words[good[0]]}" in _not_names:
                continue
            told = bool(_told.search(before)) or i == 0 or not before.strip() or before.rstrip(" ")[-1:] in ".!?\n\":;"
            accented = sum(1 for j in [i, *good] if source[slice(*tape.source(tokens[j].start(), tokens[j].end()))] != tokens[j][0])
            if not title and own not in SMALL_SURNAMES and not (bare and words[i] in PLAIN_SMALL):
                continue
            if surname and not bare and accented >= 2 and not _thing.search(before) or surname and told and len(good) >= 1 and not _thing.search(before):
                yield t.start(), tokens[good[-1]].end(), "name"
                used = good[-1]
            elif title and not surname and told and len(good) == 1 and accented >= 1 and words[good[0]] not in ("nam", "anh", "chi", "an", "sinh", "thanh", "the", "minh", "my"):
                yield t.start(), tokens[good[-1]].end(), "name"
                used = good[-1]


def findings(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in the source, in order and without overlap."""
    if not text or text.isspace():
        return []
    tape = normal(text)
    plain = tape.text
    taken: list[Found] = []
    marks = bytearray(len(plain))  # characters of links and findings

    def free(a: int, b: int) -> bool:
        return marks.find(1, a, b) < 0

    def take(a: int, b: int, kind: str) -> None:
        taken.append((a, b, kind))
        marks[a:b] = b"\x01" * (b - a)

    words = tape.words
    if "@" in plain:
        for m in _email.finditer(plain):
            take(*m.span(), "email")
    for m in _url.finditer(plain) if "://" in plain or "www" in words else ():
        marks[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
    addresses = None if words.isdisjoint(ADDRESS_WORDS) else _address
    if _any_digit.search(plain):
        for m in _id.finditer(plain) if not words.isdisjoint(ID_WORDS) else ():
            value = m["value"]
            digits = re.sub(r"\D", "", value)
            if 7 <= len(digits) <= 13 and free(*m.span("value")):
                take(*m.span("value"), "id_number")
        for m in addresses.finditer(plain) if addresses else ():
            if free(*m.span()):
                take(*m.span(), "address")
        for m in _number.finditer(plain):
            a, end = m.start(), m.end()
            if not free(a, end) or _other_number.search(plain[max(0, a - 45) : a]):
                continue
            shown = m[0]
            cuts = [len(shown), *sorted((s.start() for s in re.finditer(r"[ ,]", shown)), reverse=True)]
            size = next((n for cut in cuts if (n := _phone_end(shown[:cut]))), 0)
            if size:
                take(a, a + size, "phone")
        for m in _bare_id.finditer(plain):
            if free(*m.span()) and not _other_number.search(plain[max(0, m.start() - 45) : m.start()]):
                take(*m.span(), "id_number")
    elif addresses:
        for m in _address.finditer(plain):
            if free(*m.span()):
                take(*m.span(), "address")
    for a, b, kind in _names(tape, text):
        if free(a, b):
            take(a, b, kind)
    return sorted((*tape.source(a, b), kind) for a, b, kind in taken)


def redacted(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("kind", pa.string())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            texts = part.column(2).to_pylist()
            found = [findings(x) for x in texts]
            rows = [[{"start_char": a, "end_char": b, "kind": k} for a, b, k in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([redacted(x, f) for x, f in zip(texts, found)], pa.string()), pa.array(rows, spans)], names=["key", "field", "redacted", "found"]
            )


def personal(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(``key``, field, redacted, found) of every text of the fields that isn't null; a narrow pass.

    ``found`` is an array of (start_char, end_char, kind) in the source text.
    """
    texts = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("x"))
    texts = texts.select("key", "x.field", "x.text").where(F.col("text").isNotNull())
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("field", T.StringType()), T.StructField("redacted", T.StringType())])
    schema.add("found", T.ArrayType(T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("kind", T.StringType())])))
    return texts.mapInArrow(_rows, schema).withColumnRenamed("key", key)
