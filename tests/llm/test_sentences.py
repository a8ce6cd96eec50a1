from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.sentences import language_key, sentences, units


def cut(t):
    return [t[a:b] for a, b in units(t)]


CASES = {
    "en": (["It fails at 3.5 KB, cf. Fig. 4, e.g. in a.dll.", "No. 7 on the list (approx. 3 hops) ends.", "Why at all?!", "(Compare X, rev. 6.)", "pNode stays null.", "sub_18A trusts it!"], " "),
    "quote": (['The log says "Is it open?" and then stops.', 'It reads "do not free twice."', 'The broker asks "Who? Me?" and waits... then leaves.'], " "),
    "names": (["Do not call a.sys!Foo before.", "The export ?Foo@@YAXH@Z and the .pdata section grew.", "It fails…", "Then it ends, etc.", "The rest goes on."], " "),
    "de": (["Das gilt z. B. für a.dll, d. h. für alle.", "Am 3. Mai lief es in ca. 4 % der Fälle.", "Laut Abschn. 8 bzw. Abb. 3 liegt es da.", "Der Kommentar „Nie zweimal!“ steht da."], " "),
    "fr": (["Il lit, p. ex. dans Foo, trop.", "Attention au verrou !", "Le journal indique « accès refusé ! » puis s'arrête.", "Env. 4 % passent, cf. fig. 8 plus haut."], " "),
    "es": (["¿Quién libera el búfer?", "¡No llames a Foo!", "Véase la pág. 5 y el núm. 6, p. ej. en Foo."], " "),
    "ru": (["См. рис. 5, т. е. схему.", "Журнал пишет «нет!» и умолкает.", "Модуль, напр. в Foo, читает."], " "),
    "zh": (["这个句柄由谁关闭？", "日志中“是否已打开？”这一行出现了5次。", "大约5%的路径到不了这里……", "版本1.2.3覆盖！"], ""),
    "ja": (["ログに「開いていますか。」と表示される。", "信頼できるか？", "約3.5倍に広げる。"], ""),
    "ko": (['로그에 "열려 있습니까?"라고 표시된다.', "분석기는 읽는다."], " "),
    "hi": (["यह शाखा पढ़ता है।", "यह बफ़र कौन मुक्त करता है?"], " "),
    "ar": (["من يحرر هذا المخزن؟", "يحذف هذا الفرع."], " "),
    "th": (["รุ่น 4.3 ย้ายการตรวจสอบ", "บัฟเฟอร์ไม่มีใครคืน", "โมดูล a.dll อ่านเกินมา 5 ไบต์"], " "),
}


@pytest.mark.parametrize("name", CASES)
def test_languages(name):
    want, gap = CASES[name]
    assert cut(gap.join(want)) == want
    if gap:
        assert [x.replace("\n", " ") for x in cut("\n".join(gap.join(want).split(" ")))] == want  # every blank a line end


#: (language tag, the sentences of one text, what stands between them)
BY_LANGUAGE = [
    ("en", ["He said no.", "5 people came.", "See no. 5 and No. 6 of it."], " "),
    ("en-EN", ["The value was z.", "Then we left."], " "),
    ("EN", ["We met J. Smith and J. R. R. Tolkien in St. Petersburg.", "Gen. Lee and Col. Kurtz left.", "It is on Main St.", "The end."], " "),
    ("en", ["Dr. Who is on at 5 p. m. and at 9 a.m. too.", "We chose plan B.", "Then it failed."], " "),
    ("de_DE", ["Das gilt z. B. Montag und z.B. Dienstag.", "Hr. Meier wohnt in St. Gallen.", "Am 3. Mai war es so."], " "),
    ("fr", ["M. Dupont et Mme. Curie sont dans la salle.", "Il lit le livre."], " "),
    ("es", ["El sr. López llega a las 5 p. m. en punto.", "Dice que no.", "5 personas vienen."], " "),
    (None, ["Vgl. Abschn. 8 in der Liste.", "See approx. Two of the lines."], " "),
    ("ja", ["The scan ran vs. Windows in all modes.", "これは本だ。", "終わり。"], " "),
    ("en", ["Is it true?", "Yes, so be it."], ""),
    ("hi", ["यह पढ़ता है।", "वह लिखता है।", "क्या?"], ""),
    ("km", ["ខ្ញុំអាន។", "គាត់សរសេរ។"], ""),
    ("my", ["ငါဖတ်တယ်။", "သူရေးတယ်။"], ""),
    ("ar", ["من هنا؟", "نعم۔", "لا."], ""),
    ("am", ["እሱ አነበበ።", "እሷ ጻፈች።"], ""),
    ("hy", ["Նա կարդում է։", "Նա գրում է։"], ""),
]


@pytest.mark.parametrize("lang,want,gap", BY_LANGUAGE)
def test_by_language(lang, want, gap):
    t = gap.join(want)
    assert [t[a:b] for a, b in units(t, lang)] == want


def test_language_keys():
    assert [language_key(x) for x in (" de-DE", "EN", "pt_BR", "und", "", None)] == ["de", "en", "pt", None, None, None]


def test_layout():
    t = "# Title no. 4\r\n\r\nOne. Two\r\nlines.\r\n\r\nThe scan shows:\r\n- First. Still first.\r\n2. second\r\n  goes on\r\n\r\n```c\nint a; // x. y\n\nb();\n```\r\n\r\nSummary of x.dll\n\t \nLast."
    assert cut(t) == ["# Title no. 4", "One.", "Two\r\nlines.", "The scan shows:", "- First. Still first.", "2. second\r\n  goes on", "```c\nint a; // x. y\n\nb();\n```", "Summary of x.dll", "Last."]
    assert cut("a.\n```\nopen. end") == ["a.", "```\nopen. end"]
    assert cut("See note\n385. The next.") == ["See note\n385.", "The next."]


@pytest.mark.parametrize("t", ["", " ", "\n\t\r\n", " "])
def test_nothing(t):
    assert cut(t) == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB. !?。」“\"')(\n\r#-*`1:ไม्।…«»")), max_size=80))
def test_every_character_once(t):
    last = 0
    for a, b in units(t):
        assert last <= a < b and not t[last:a].strip() and not t[a].isspace() and not t[b - 1].isspace()
        last = b
    assert not t[last:].strip()


def test_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 0), (2, None, 0), (3, "", 0), (1, "A b. C d.", 0), (4, "🙂 xy. Yz.", 0), (5, "Zed. " * 50_000, 0)], "doc_id bigint, text string, sent_start int")
    got = sorted(map(tuple, sentences(df, "doc_id", "text").where("doc_id < 5").collect()))
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 0, 5), (4, 6, 9)]
    assert sentences(df.where("doc_id = 5"), "doc_id", "text").count() == 50_000
    assert sentences(df.limit(0), "doc_id", "text").count() == 0
