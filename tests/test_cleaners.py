"""Each cleaner against vectors: (options, [(input, expected)])."""

import pytest

from burnish import BoolCleaner, ColRenamer, CountryCleaner, DateTimeCleaner, EmailCleaner, GenderCleaner, NumericCleaner, PhoneCleaner, TextCleaner, UuidCleaner

U = "0b9c6f3e-71ad-4c55-9d20-5e8f0a2b7c41"
VECTORS = [
    (TextCleaner(), [("A <b>bold</b> claim", "a bold claim"), ("see https://docs.example.net/a?b=1 first", "see first"), ("open www.example.net/x or wait", "open or wait"), ("ask ops@example.net please", "ask please"), ("one\ntwo\r\nthree", "one two three"), ("MiXeD", "mixed"), ("tabs\tand   gaps", "tabs and gaps"), ("<br/><hr>", None), ("\t \n", None)]),
    (TextCleaner(remove_html=False), [("keep <i>this</i>", "keep <i>this</i>")]),
    (TextCleaner(remove_digits=True), [("room 27 on floor 3", "room on floor"), ("2027", None)]),
    (TextCleaner(remove_punctuation=True), [("Well... (maybe), no?", "well maybe no"), ("--;--", None)]),
    (TextCleaner(replace_newlines_with_spaces=False), [("left\nright", "leftright")]),
    (TextCleaner(lowercase=False), [("Keep My Case", "Keep My Case")]),
    (TextCleaner(remove_punctuation=True, remove_digits=True), [("<li>Ticket #42: ask desk@example.net, see www.example.net!</li>\nBye.", "ticket ask see bye")]),
    (EmailCleaner(), [(" Mia.Lund+News@Example.org ", "mia.lund+news@example.org"), ("TEAM@mail.example.co.uk", "team@mail.example.co.uk"), ("write to o_k%1@a-b.io now", "o_k%1@a-b.io"), ("q+@Z.org", "q@z.org"), ("user@host", None), ("nobody", None)]),
    (EmailCleaner(lowercase=False), [("q+@Z.org", "q+@Z.org")]),
    (EmailCleaner(keep_tags=False), [("c.d+promo@z.org", "c.d@z.org")]),
    (EmailCleaner(keep_dots=False), [("c.d+p.q@z.org", "cd+p.q@z.org")]),
    (EmailCleaner(split_components=True), [("Kim+Box@Z.org", ("kim", "box", "z.org")), ("kim@z.org", ("kim", None, "z.org")), ("-", (None, None, None))]),
    (PhoneCleaner(), [("+91 91234 56780", "+919123456780"), ("+1 (212) 664-7665", "+12126647665"), ("+44 20 7946 0958", "+442079460958"), ("9123456780", None), ("022-24567890", None)]),
    (PhoneCleaner(default_regions=("IN",)), [("9.12345678E+09", "+919123456780"), ("022-24567890", "+912224567890"), ("unknown", None), ("12345", None), ("ring 9123456780 after six", "+919123456780"), ("919123456780", "+919123456780"), ("2e500", None)]),
    (PhoneCleaner(default_regions=("US", "IN")), [("(212) 664-7665", "+12126647665"), ("91234 56780 9", None)]),
    (PhoneCleaner(), [("+49 30 1234567", "+49301234567"), ("+55 11 91234-5678", "+5511912345678"), ("+81 90-1234-5678", "+819012345678"), ("+7 912 345 67 89", "+79123456789"), ("+55 11 1234", None), ("+86 138 0013 8000", "+8613800138000")]),
    (PhoneCleaner(default_regions=("DE", "BR")), [("030 1234567", "+49301234567"), ("(11) 91234-5678", "+5511912345678")]),
    (PhoneCleaner(default_regions=("BR",), out_format=PhoneCleaner.Format.NATIONAL), [("11912345678", "(11) 91234-5678"), ("+7 912 345 67 89", "8 (912) 345-67-89"), ("+41 44 668 18 00", "044 668 18 00")]),
    (PhoneCleaner(default_regions=("IN",)), [("  ٩١٢٣٤٥٦٧٨٠ ", "+919123456780"), ("९.12345678E+09\n", "+919123456780"), ("1e3", None), ("", None), ("order １２ then ９１２３４５６７８０", "+919123456780"), ("order １２３４５６ then 9123456780", None)]),
    (PhoneCleaner(default_regions=("IN",), out_format=PhoneCleaner.Format.INTERNATIONAL), [("9123456780", "+91 91234 56780")]),
    (PhoneCleaner(default_regions=("IN",), out_format=PhoneCleaner.Format.NATIONAL), [("9123456780", "091234 56780")]),
    (PhoneCleaner(default_regions=("IN",), out_format=PhoneCleaner.Format.RAW_DIGITS), [("9123456780", "919123456780")]),
    (NumericCleaner(), [("731.25", 731.25), ("-8.5", -8.5), ("12,345.5", 12345.5), ("€ 9,001.75", 9001.75), ("27..5", 27.5), ("8..1.2", 8.12), ("3.25.100", 3.251), ("seven", None), ("level 7", None), ("about 7", 7.0), ("4 pieces", None), ("2e500", None), ("1e25", 1e25), ("٧", 7.0), ("", None), ("inf", None)]),
    (NumericCleaner(out_format=NumericCleaner.Format.INT), [("62", 62), ("£7,250", 7250), ("-8.9", -8)]),
    (NumericCleaner(precision=2), [("3.145", 3.15), ("3.144", 3.14), ("2.675", 2.68)]),
    (NumericCleaner(precision=0), [("41.7", 42.0)]),
    (NumericCleaner(precision=4), [("2.718281", 2.7183)]),
    (NumericCleaner(parse_suffixes=True), [("3.5M", 3.5e6), ("12k", 1.2e4), ("€ 1.5 B", 1.5e9), ("0.5 t", 5e11), ("77", 77.0), ("2,400k", 4e5)]),
    (BoolCleaner(), [("TRUE", True), ("Yes", True), ("1", True), ("no", False), ("FALSE", False), ("0", False), ("perhaps", None)]),
    (BoolCleaner(out_format=BoolCleaner.Format.BINARY), [("yes", "1"), ("Active", "1"), ("no", "0"), ("INACTIVE", "0")]),
    (BoolCleaner(out_format=BoolCleaner.Format.YESNO), [("y", "Yes"), ("t", "Yes"), ("n", "No"), ("f", "No")]),
    (GenderCleaner(), [("MALE", "Male"), ("F", "Female"), ("Man", "Male"), ("Woman", "Female"), ("other", "Other"), ("robot", None), (" f", None)]),
    (GenderCleaner(out_format=GenderCleaner.Format.CHAR), [("boy", "M"), ("girl", "F"), ("non-binary", "O")]),
    (GenderCleaner(out_format=GenderCleaner.Format.BINARY), [("m", "1"), ("woman", "0"), ("o", "-1")]),
    (DateTimeCleaner(), [("2031-02-07 08:09:10", "2031-02-07T08:09:10"), ("2031-02-07", "2031-02-07T00:00:00"), ("08:09:10", "0001-01-01T08:09:10"), ("soon", None), ("2031/14/02", None), ("2031-2-7", "2031-02-07T00:00:00"), ("2031-02- 7", "2031-02-07T00:00:00"), ("9:15AM", None), ("2031-04-31", None), ("0000-05-05", None), ("2031-02-07 08:09:60", None), ("2031-02-07\n", None)]),
    (DateTimeCleaner(out_format=DateTimeCleaner.Format.ISO_DATE), [("2031-02-07T08:09:10", "2031-02-07"), ("07-02-2031", "2031-02-07"), ("08:09:10", None)]),
    (DateTimeCleaner(out_format=DateTimeCleaner.Format.INDIAN_DATE), [("07/02/2031", "07-02-2031"), ("9:15 AM", None)]),
    (DateTimeCleaner(out_format=DateTimeCleaner.Format.ISO_TIME), [("9:15 PM", "21:15:00"), ("12:40 am", "00:40:00")]),
    (CountryCleaner(), [("NO", "Norway"), ("BRA", "Brazil"), ("kenya", "Kenya"), ("Atlantis", None), ("QQQ", None), ("new zeal", "New Zealand")]),
    (CountryCleaner(in_format=CountryCleaner.Format.ALPHA2, out_format=CountryCleaner.Format.ALPHA3), [("NO", "NOR"), ("br", "BRA"), ("Kenya", None)]),
    (CountryCleaner(in_format=CountryCleaner.Format.NAME, out_format=CountryCleaner.Format.ALPHA3), [("New Zealand", "NZL")]),
    (UuidCleaner(), [(U, U), ("{" + U.upper() + "}", U), ("urn:uuid:" + U, U), (U.replace("-", ""), U), (f'"{U}"', U), ("0b9c6f3e-71ad", None), (U[:-1] + "G", None)]),
    (UuidCleaner(out_format=UuidCleaner.Format.URN), [(U, "urn:uuid:" + U)]),
    (UuidCleaner(out_format=UuidCleaner.Format.COMPACT, allowed_versions={4}), [(U, U.replace("-", ""))]),
    (UuidCleaner(allowed_versions={7}), [(U, None)]),
]


@pytest.mark.parametrize("cleaner, pairs", VECTORS, ids=[f"{type(c).__name__}{k}" for k, (c, _) in enumerate(VECTORS)])
def test_vectors(spark, cleaner, pairs):
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate([*pairs, (None, None)])], "k int, v string")
    rows = df.select("k", cleaner.clean_expr("v").alias("v")).orderBy("k").collect()
    got = [tuple(r.v) if isinstance(r.v, tuple) else r.v for r in rows]
    assert got[:-1] == [want for _, want in pairs]
    assert got[-1] is None or set(got[-1]) == {None}


@pytest.mark.parametrize("cleaner", [c for c, _ in VECTORS], ids=range(len(VECTORS)))
def test_plans_are_narrow_and_native(spark, cleaner):
    df = spark.createDataFrame([("x",)], "v string").select(cleaner.clean_expr("v").alias("v"))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text


def test_clean_value_and_options(spark):
    assert EmailCleaner().clean_value(" A@b.Com ") == "a@b.com"
    assert NumericCleaner().clean_value(12.5) == 12.5
    assert TextCleaner().clean_value(12) is None
    assert EmailCleaner(split_components=True).clean_value("a+t@b.com") == ("a", "t", "b.com")
    assert EmailCleaner(split_components=True).output_schema() == (("local", "str"), ("tag", "str"), ("domain", "str"))
    assert BoolCleaner().output_schema() == "bool" and PhoneCleaner.name() == "PhoneCleaner"
    for bad in (lambda: TextCleaner(lowercase=1), lambda: BoolCleaner(out_format="yesno")):
        with pytest.raises(TypeError):
            bad()
    with pytest.raises(ValueError):
        NumericCleaner(precision=-1)
    with pytest.raises(ValueError):
        CountryCleaner(out_format=CountryCleaner.Format.AUTO)


SCORES = [
    (PhoneCleaner(), {"home_phone": 1, "mobile": 1, "tel_2": 1, "fax_line": 1, "city": 0}),
    (DateTimeCleaner(), {"paid_at": 1, "birth_date": 1, "start_time": 1, "city": 0}),
    (TextCleaner(), {"buyer_comment": 0.8, "long_description": 0.8, "staff_notes": 0.8, "city": 0.1}),
    (CountryCleaner(), {"home_country": 1, "Country": 1, "city": 0}),
    (GenderCleaner(), {"buyer_gender": 1, "sex": 1, "city": 0}),
    (BoolCleaner(), {"is_open": 1, "has_car": 1, "spam_flag": 1, "city": 0}),
    (EmailCleaner(), {"work_email": 1, "city": 0}),
    (UuidCleaner(), {"row_uuid": 1, "order_guid": 1, "city": 0}),
]


@pytest.mark.parametrize("cleaner, names", SCORES, ids=[type(c).__name__ for c, _ in SCORES])
def test_name_scores(cleaner, names):
    assert {n: cleaner.name_score(n) for n in names} == names


RENAMED = {
    "snake": ("first_name", "user_id"), "upper_snake": ("FIRST_NAME", "USER_ID"), "upper": ("FIRSTNAME", "USERID"), "lower": ("firstname", "userid"), "pascal": ("FirstName", "UserId"),
    "camel": ("firstName", "userId"), "kebab": ("first-name", "user-id"), "train": ("First-Name", "User-Id"), "cobol": ("FIRST-NAME", "USER-ID"),
}


@pytest.mark.parametrize("case", RENAMED)
def test_renamer(case):
    r = ColRenamer(case)
    assert (r.rename("First Name"), r.rename("userID")) == RENAMED[case]
    assert r.rename("???") == "???"
    assert r.rename_cols([RENAMED[case][0]]) == {}
    with pytest.raises(ValueError):
        ColRenamer("none")
