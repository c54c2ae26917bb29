"""Consistent forms, defects of pairs, personal information."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import forms, pairs, privacy


@pytest.mark.parametrize(
    "text, form",
    [
        (None, None), ("", ""), (" \t\n ", " \t\n "), ("Thẻ  của tôi", "Thẻ  của tôi"), ("Ｔｈｅ", "The"), ("ﬁ", "fi"), ("ệ", "ệ"), ("a​b﻿c­d", "abcd"), ("a b　c", "a b c"),
        ("e‍́", "é"), ("ѕаng", "sang"), ("Ηà", "Hà"), ("сосо", "сосо"), ("Москва", "Москва"), ("МосkBa", "MocкBa".replace("к", "k")), ("Ωmega", "Ωmega"), ("αβ", "αβ"), ("line x", "line x"),
    ],
)
def test_forms(text, form):
    assert forms.consistent(text) == form


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aệệ​  \n\tБсосоαοｘＡﬁ1́")))
def test_forms_are_stable_and_normal(text):
    form = forms.consistent(text)
    assert forms.consistent(form) == form
    assert unicodedata.is_normalized("NFKC", form)
    assert "​" not in form and " " not in form


def test_scripts():
    assert forms.whole_script_confusable("сосо") and not forms.whole_script_confusable("Москва") and not forms.whole_script_confusable("coco")


@pytest.mark.parametrize(
    "token, spelling, kind",
    [("сосо", "сосо", "whole"), ("Москва", "Москва", None), ("Vіеt", "Viet", "mixed"), ("cепter", "ceпter", "partial"), ("αе", "αе", "foreign"), ("bank", "bank", None), ("phí", "phí", None), ("Ηà", "Hà", "mixed")],
)
def test_tokens_are_resolved_by_the_intersection_of_script_sets(token, spelling, kind):
    assert forms.resolved(token) == (spelling, kind)


def test_lookalikes_are_reported(spark):
    rows = [(1, "сосо и Москва", None), (2, "Vіеt cепter", "thẻ"), (3, "", "αе")]
    got = {r["id"]: (r["a_lookalikes"], r["b_lookalikes"]) for r in forms.consistent_forms(spark.createDataFrame(rows, "id long, a string, b string"), "id", ["a", "b"]).collect()}
    assert got == {1: (["whole"], []), 2: (["mixed", "partial"], []), 3: ([], ["foreign"])}


Q = "Ngày 02/10/2024 tôi thanh toán hoá đơn trên máy Brisa, thẻ bị từ chối, vậy khoản 37.708.000 đồng có về ngân hàng không?"
GOOD = "Bạn vào Thẻ của tôi, chọn Tra soát rồi bấm Đồng ý để tra soát giao dịch trong giờ hành chính."


@pytest.mark.parametrize(
    "question, answer, kind",
    [
        (Q, None, "empty_answer"), (Q, "", "empty_answer"), (Q, "​\n", "empty_answer"), (Q, "N/A", "empty_answer"), (Q, "(trống)", "empty_answer"), (Q, "<p></p>", "empty_answer"), (Q, "Đang cập nhật", "empty_answer"), (None, "...", "empty_answer"),
        (Q, Q, "copied_question"), (Q, f'"{Q}"', "copied_question"), (Q, f"Câu hỏi: {Q} {Q}", "copied_question"), (Q, Q.upper(), "copied_question"), (Q, pairs.folded(Q), "copied_question"), (Q, f"Xin lỗi vì sự bất tiện này. {Q} {GOOD}", None),
        (Q, "Xin lỗi, tôi không thể trả lời câu hỏi về phí nạp tiền. Bạn thử liên hệ trang trợ giúp.", "refusal"), (Q, "As an AI assistant I am not able to advise on fees.", "refusal"), (Q, f"Xin lỗi vì sự bất tiện này. {GOOD}", None),
        (Q, "Si la session a expiré, l'ordre sera renvoyé avant 18:03. Vous pouvez payer une facture jusqu'à la banque.", "other_language"), (Q, "Обработка занимает 53 часа, а банк может добавить ещё 45 дней.", "other_language"), (Q, "Ban vao The cua toi, chon Tra soat roi bam Dong y de tra soat giao dich trong gio hanh chinh.", None),
        (Q, f"{GOOD} Các bước thực hiện như sau:", "truncated_answer"), (Q, f"{GOOD} Mức áp dụng (tính theo sinh viên", "truncated_answer"), (Q, f"{GOOD} Nếu lệnh bị trả lại thì b", "truncated_answer"), (Q, "Bạn làm đủ 3 bước sau:\n1. Mở thẻ.\n2. Chọn mục.", "truncated_answer"),
        (Q, f"{GOOD}\n- Phí: 9.000 đồng\n- Thời gian: 5 phút", None), (None, GOOD, None), ("nan", GOOD, None), (Q, f"{GOOD}\nXem thêm: https://tro-giup.example/bai/1", None),
    ],
)
def test_defects(question, answer, kind):
    assert (pairs.defects(question, answer) or [None])[0] == kind


@pytest.mark.parametrize(
    "answer, kind",
    [
        (" " * 201, "empty_answer"), ("\n" * 300, "empty_answer"), ("." * 250, "empty_answer"), ("- " * 200, "empty_answer"), ("<p>&nbsp;</p>" * 40, "empty_answer"), ("N/A" + " ." * 150, "empty_answer"), (" " * 300 + "Đang cập nhật", "empty_answer"),
        ((Q + " ") * 12, "copied_question"), (f"Câu hỏi: {Q} " * 9, "copied_question"), (f"{Q} " * 9 + GOOD, None),
        ("Xin lỗi, tôi không thể trả lời câu hỏi này. " + "Bạn liên hệ chi nhánh gần nhất hoặc hỏi nhân viên tại quầy giao dịch. " * 12, "refusal"), ("Tôi không thể trả lời câu hỏi này. Vui lòng liên hệ:\n" + "Hotline: 1900 545 415\nChi nhánh Cầu Giấy, quầy 2\n" * 12 + "Email cho bộ phận hỗ trợ.", "refusal"), ("Xin lỗi, tôi không thể trả lời câu hỏi này. " + f"{GOOD} " * 12, None), (" ".join([GOOD] * 20), None),
    ],
)
def test_defects_at_any_length(answer, kind):
    assert (pairs.defects(Q, answer) or [None])[0] == kind


@pytest.mark.parametrize(
    "question, answer, other",
    [
        ("Card declined?", "Обработка занимает 53 часа, а банк может добавить ещё дней.", True), (Q, "您可以在应用中查看交易状态。", True), (Q, "カードの設定を開いてください。", True), (Q, "카드 설정에서 확인하실 수 있습니다.", True), (Q, "คุณสามารถตรวจสอบได้ในแอป", True),
        (Q, "يمكنك التحقق من ذلك في التطبيق.", True), (Q, "Μπορείτε να το ελέγξετε στην εφαρμογή.", True), ("Как сменить код?", "Open the card menu, then choose the code.", True), ("Как сменить код?", "Visa Mastercard", False), ("カードの暗証番号は？", "設定画面で変更可能。", False),
        ("Card declined?", "Open Google Pay.", False), (Q, GOOD, False), ("Как сменить код?", "Откройте Google Pay Wallet и смените код.", False),
    ],
)
def test_scripts_tell_languages_apart(question, answer, other):
    assert pairs.is_other_language(question, answer) == other


def test_flagged_table(spark):
    df = spark.createDataFrame([(1, Q, None, "x"), (2, Q, GOOD, "x"), (2, Q, GOOD, "x")], "id long, question string, answer string, defects string")
    assert sorted((r["id"], r["defect"]) for r in pairs.flagged(df, "id", "question", "answer").collect()) == [(1, "empty_answer"), (2, None), (2, None)]
    assert pairs.flagged(df.limit(0), "id", "question", "answer").count() == 0


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Liên hệ +84 658881259 hoặc thuan_boi.lau＠thuvien.example.net khi có kết quả.", {"phone", "email"}), ("Điện thoại: không sáu ba tám ba không không ba năm bốn", {"phone"}), ("Mail: ngan_tinh [at] hop-thu [dot] example nhé", {"email"}),
        ("cứ gửi luu-thoi(a còng)buu-cuc chấm example chấm org.", {"email"}), ("Số 06247o7504 không nhận được OTP.", {"phone"}), ("Mã giao dịch của mình là 0603815015.", set()), ("Số tài khoản 747617344235 ở ngân hàng Tân Mộc có vấn đề.", set()),
        ("CCCD số: 097 347 134 401; họ tên Đỗ Mộng Quế Đình", {"id_number", "name"}), ("This is Corwick Tolliver-Wick, passport no Z 3058404, I lost my phone.", {"id_number", "name"}), ("MST: 9933671645-001", {"id_number"}),
        ("Hạn mức khi chưa nộp hộ chiếu là 49.840.000 đồng", set()), ("Gửi thẻ mới về 20C đường Rặng Dừa, phường Phú Sim, quận Nam Cồn, TP Lạc Hải giúp tôi.", {"address"}), ("thôn Cầu Ngói, xã Đông Ngàn, huyện Bình Sa", {"address"}), ("Please mail the card to 227 Larkmoor Street.", {"address"}), ("Mình ở quận Bắc Rạch, TP Thung Đá.", set()), ("Đường dẫn số 40 trong thư không mở được.", set()),
        ("Khách chị Mận muốn đăng ký vân tay", {"name"}), ("NGHIÊM RẠNG hay dùng thẻ Mây Tím", {"name"}), ("khách nguyễn tịnh yên thoa muốn nhận hoàn tiền", {"name"}), ("Thẻ Mai Vàng Hạng Lựu chưa về. Nhờ Trợ Lý Ảo xem giúp gói An Khang Bền Lâu.", set()), ("Mình theo dõi kênh @saomai_hotro nhưng chưa thấy tin.", set()),
        ("Tôi đã xem ở https://tro-giup.saomai.example/bai/7260 mà chưa hiểu.", set()), ("", set()), ("   ", set()), (None, set()),
    ],
)
def test_personal(text, kinds):
    assert {k for *_, k in privacy.findings(text)} == kinds


def test_placeholders_keep_the_rest():
    text = "Em cần đổi số từ 0645.971 147 sang (０６６５) 575646, chị Dao nhé; mail a_b＠x.example."
    found = privacy.findings(text)
    assert privacy.redacted(text, found) == "Em cần đổi số từ [PHONE] sang [PHONE], [NAME] nhé; mail [EMAIL]."
    decomposed = unicodedata.normalize("NFD", "Khách Đỗ Tràm muốn gọi 0612345678")
    assert privacy.redacted(decomposed, privacy.findings(decomposed)) == unicodedata.normalize("NFD", "Khách ") + "[NAME]" + unicodedata.normalize("NFD", " muốn gọi ") + "[PHONE]"


def test_personal_table(spark):
    df = spark.createDataFrame([(1, None, "gọi 0612345678", "x"), (2, "", None, "x"), (1, None, "gọi 0612345678", "x")], "id long, memory string, content string, found string")
    out = privacy.personal(df, "id", ["content", "memory"]).select("id", "field", "redacted").distinct().collect()
    assert sorted(map(tuple, out)) == [(1, "content", "gọi [PHONE]"), (2, "memory", "")]
    assert privacy.personal(df.limit(0), "id", ["content", "memory"]).count() == 0


@pytest.mark.parametrize(
    "answer",
    [
        "Lo siento, no puedo responder a esa pregunta. Por favor contacte con la oficina.", "Desculpe, não posso responder a isso.", "Mi dispiace, non posso rispondere a questa domanda.", "Maaf, saya tidak dapat menjawab pertanyaan ini. Silakan hubungi cabang.",
        "抱歉，我无法回答这个问题。请联系客服。", "申し訳ございませんが、お答えできません。", "죄송합니다. 답변해 드릴 수 없습니다.", "ขออภัย ไม่สามารถตอบคำถามนี้ได้", "Je ne peux pas répondre à cette question.", "Das kann ich leider nicht beantworten.", "К сожалению, не могу ответить.",
    ],
)
def test_refusals_in_other_languages(answer):
    assert "refusal" in pairs.found_kinds(Q, answer) and pairs.defects(Q, answer)[0] == "refusal"


@pytest.mark.parametrize(
    "answer",
    [
        "您可以在银行卡页面选择查询交易，然后点击确认。", "カードのページで取引を選び、確認を押してください。", "카드 메뉴에서 거래 조회를 선택하고 확인을 누르세요.", "ไปที่บัตรของฉัน เลือกตรวจสอบ แล้วกดตกลง", "افتح بطاقتي ثم اختر التتبع واضغط موافق.", "Ανοίξτε την κάρτα μου και επιλέξτε έλεγχο.",
        "Откройте карту, выберите проверку и нажмите согласен.", "Öffnen Sie die Karte, wählen Sie die Prüfung und drücken Sie auf Zustimmen, dann wird der Betrag geprüft.",
    ],
)
def test_answers_in_another_script_or_language(answer):
    assert "other_language" in pairs.found_kinds(Q, answer)


def test_every_kind_is_given_in_the_order_of_the_rules():
    assert pairs.found_kinds(Q, "Je ne peux pas répondre à cette question (voir")[:2] == ["truncated_answer", "refusal"]
    assert pairs.defects(Q, "Je ne peux pas répondre à cette question (voir")[0] == "refusal"
    assert pairs.found_kinds(Q, None) == ["empty_answer"]


def test_copied_prefixes():
    edited = Q.replace("hoá đơn", "hóa đơn dịch vụ").replace("vậy ", "")
    assert pairs.defects(Q, edited) == ["copied_question"] and pairs.defects(Q, f"Bạn hỏi: {Q} Cảm ơn bạn")[0] == "copied_question"
    assert "copied_question" not in pairs.defects(Q, f"{Q} {GOOD}")
    shuffled = " ".join(sorted(Q.split()))
    assert "copied_question" not in pairs.defects(Q, shuffled)


# Sentences and names that the rules weren't written on; what is found is measured, see README
HELD_OUT = [
    ("Could you transfer it to Ingrid Halvorsen instead?", ["Ingrid Halvorsen"]), ("I spoke to Mateusz Wisniewski yesterday about the refund.", ["Mateusz Wisniewski"]), ("Kind regards,\nAmara Okonkwo", ["Amara Okonkwo"]), ("Hi Priya Raghunathan, your refund is on its way.", ["Priya Raghunathan"]),
    ("Yusuf Demirci travels to Hue every month.", ["Yusuf Demirci"]), ("The card belongs to Freja Lindqvist.", ["Freja Lindqvist"]), ("Miss Chiara Bellandi complained about the fee.", ["Chiara Bellandi"]), ("my name is tomas novak", ["tomas novak"]),
    ("sofia petrova usually shops online", ["sofia petrova"]), ("On behalf of Declan O'Sullivan, I request a new PIN.", ["Declan O'Sullivan"]), ("Please reach Keiko Yamashita before noon.", ["Keiko Yamashita"]), ("Leila Haddad mentioned the wrong amount.", ["Leila Haddad"]),
    ("Signed by Bram van Houten", ["Bram van Houten"]), ("Our neighbour Gustavo Pereira saw it too.", ["Gustavo Pereira"]), ("This is Nadia Benali, I need help.", ["Nadia Benali"]), ("Dear Ms. Eilidh MacGregor,\nthank you.", ["Eilidh MacGregor"]),
    ("Olga Smirnova has never paid late.", ["Olga Smirnova"]), ("contact person: Rashid Khan", ["Rashid Khan"]), ("Người nhận: Phan Thị Kim Ngân", ["Phan Thị Kim Ngân"]), ("Em là Trần Quốc Bảo ạ", ["Trần Quốc Bảo"]),
    ("Gửi cho chị Hạnh giúp em", ["chị Hạnh"]), ("Chủ tài khoản là Vàng Thị Mỷ", ["Vàng Thị Mỷ"]), ("Bạn tôi, Đặng Hữu Phước, cũng bị lỗi", ["Đặng Hữu Phước"]), ("Mình tên Lê Minh Khôi", ["Lê Minh Khôi"]),
    ("The Mossbank wallet often fails.", []), ("Thanks for the quick answer.", []), ("Contact Support Team about it.", []), ("Open My Cards and choose Block Card.", []), ("I am in District Seven now.", []), ("Hello, is anyone there?", []), ("Ngân hàng Phương Đông báo lỗi", []), ("Tôi ở Quận Tân Bình", []), ("this is not working, please help", []), ("Monday Morning Report usually arrives late", []),
]


def test_held_out_names():
    wanted = found = wrong = 0
    for text, names in HELD_OUT:
        got = {text[a:b] for a, b, kind in privacy.findings(text) if kind == "name"}
        wanted, found, wrong = wanted + len(names), found + len(got & set(names)), wrong + len(got - set(names))
    print(f"names wanted {wanted}, found {found}, wrong {wrong}")
    assert found >= 0.6 * wanted and wrong <= 3


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("Maria Garcia rarely pays by card.", ["name"]), ("maria garcia rarely pays by card", ["name"]), ("my contact is john smith", ["name"]), ("My contact is Zhang Wei.", ["name"]), ("ask for Oluwaseun Adeyemi", ["name"]), ("Tôi là Sùng A Páo", ["name"]), ("khách Lò Thị Mai hỏi phí", ["name"]),
        ("mail foo at bar dot com", ["email"]), ("meet me at noon dot", []), ("call 415-555-2671", ["phone"]), ("SSN 123-45-6789", ["id_number"]), ("the customer often pays", []), ("my name is already known.", []), ("visa platinum usually works", []), ("Call me on Monday", []),
    ],
)
def test_mentions_without_a_list(text, kinds):
    assert [k for _, _, k in privacy.findings(text)] == kinds
