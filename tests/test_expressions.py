"""Expressions against small tables of cases and against plain Python."""

import datetime as dt
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vitrine.functions import store as S
from vitrine.functions import text as X
from vitrine.functions import values as V
from vitrine.functions.sections import is_heading, number_and_ancestors, pack


def values(spark, column, cases):
    """Evaluate ``column`` (over a text column ``c``) for each case."""
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[1] for r in sorted(df.select("i", column).collect())]


def test_fold_matches_unicode_decomposition(spark):
    cases = ["Violão ÉÇ", "ÑANDÚ", "Straße", "ão", "Ação Ấm", "plain", "", "œuvre Øre", "Ά Έργο", "Йод ёлка", "שָׁלוֹם", "नि़क", "が ガ"]

    def expected(t):
        return "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))

    assert values(spark, X.fold(F.col("c")), cases) == [expected(t) for t in cases]
    assert values(spark, X.fold(F.col("c")), [None]) == [""]


def test_query_terms(spark):
    cases = ["um dois tres quatro cinco seis sete oito nove", "Foo_Bar foo", "  ", "Violão VIOLAO", "AND or NOT"]
    assert values(spark, X.query_terms(F.col("c")), cases) == [
        ["um", "dois", "tres", "quatro", "cinco", "seis", "sete", "oito", "nove"],
        ["foo", "bar"],
        [],
        ["violao"],
        ["and", "or", "not"],
    ]
    assert values(spark, X.query_terms(F.col("c"), most=2), cases[:1]) == [["um", "dois"]]
    assert values(spark, X.query_terms(F.col("c"), stems=True), ["percussao pia"]) == [["percussao", "percus", "pia"]]


@pytest.mark.parametrize(
    "email, shown",
    [("ana@x.com", "an*@x.com"), ("a@x.com", "a*@x.com"), ("maria@a@b", "ma***@a@b"), ("no mail", "no mail"), (None, None)],
)
def test_mask_email(spark, email, shown):
    assert values(spark, X.mask_email(F.col("c")), [email]) == [shown]


def test_mask_phone(spark):
    cases = ["(67) 99999-1234", "12345678", "123", "", None]
    assert values(spark, X.mask_phone(F.col("c"), compat=True), cases) == ["(67)*******1234", "12345678", "123123", "", None]
    assert values(spark, X.mask_phone(F.col("c"), compat=False), cases)[1:3] == ["********", "***"]


def test_payment_label(spark):
    cases = ["pix", "debit", "boleto", "credit_6x", "credit_12x_old", "voucher", "", None]
    assert values(spark, S.payment_label(F.col("c")), cases) == [
        "PIX", "Cartão de Débito", "Boleto Bancário", "Cartão de Crédito 6x", "Cartão de Crédito 12x", "voucher", "-", "-",
    ]


def test_iso_date(spark):
    cases = ["2025-02-28", "20250228", "2025-02-30", "2025-2-3", "28/02/2025", "", None]
    day = dt.date(2025, 2, 28)
    assert values(spark, S.iso_date(F.col("c")), cases) == [day, day, None, None, None, None, None]


@pytest.mark.parametrize(
    "price, percent, expected", [("549.0", 20, "439.20"), ("2399", 18, "1967.18"), ("359", 10, "323.10"), ("0.05", 50, "0.03")]
)
def test_promo_price_rounds_half_up_in_decimals(spark, price, percent, expected):
    got = spark.range(1).select(S.promo_price(F.lit(price).cast("decimal(12,2)"), F.lit(percent))).first()[0]
    assert str(got) == expected


def test_deadlines_on_boundary_days(spark):
    ref = dt.date(2025, 12, 22)
    rows = [(n, "delivered", ref, None) for n in (0, 7, 8, 30, 31)]
    rows += [(100, "delivered", None, ref), (101, "delivered", None, None), (102, "shipped", ref, ref), (103, None, ref, ref)]
    df = spark.createDataFrame(rows, "n int, status string, delivery date, ordered date")
    day = F.date_add(F.lit(ref), F.when(F.col("n") < 100, F.col("n")).otherwise(0))
    got = {
        r.n: (r.d, r.note)
        for r in df.select(
            "n",
            S.deadlines(F.col("status"), F.col("delivery"), F.col("ordered"), day).alias("d"),
            S.deadlines_note(F.col("status"), F.col("delivery"), F.col("ordered")).alias("note"),
        ).collect()
    }
    flags = {n: (d.arrependimento_7d_expirado, d.troca_defeito_30d_expirado, d.caminho_sugerido) for n, (d, _) in got.items() if d}
    assert flags[0] == flags[7] == (False, False, V.PATH_OPEN)
    assert flags[8] == flags[30] == (True, False, V.PATH_DEFECT)
    assert flags[31] == (True, True, V.PATH_EXPIRED)
    assert got[0][0].arrependimento_7d_ate == "29/12/2025" and got[0][0].referencia == "entrega estimada em 22/12/2025"
    assert got[100][0].ref_source == "order_date"
    assert got[101] == (None, V.NOTE_NO_DATE)
    assert got[102] == got[103] == (None, V.NOTE_NOT_DELIVERED)


def test_strip_and_lines_follow_python(spark):
    cases = ["　 a\t", "x\x0by\r\nz w", "\xa0"]
    assert values(spark, X.strip(F.col("c")), cases) == [c.strip() for c in cases]
    assert values(spark, X.lines(F.col("c")), cases) == [c.splitlines() for c in cases]


def test_headings(spark):
    cases = ["1. Título", "4 Prazo", "4.2. Troca", "10 dias para devolver.", "3. " + "x" * 91, "Sem número", "2.Colado"]
    assert values(spark, is_heading(F.col("c")), cases) == [True, True, True, False, False, False, False]


def test_number_and_ancestors(spark):
    assert values(spark, number_and_ancestors(F.col("c")), ["4.2.1", "40"]) == [["4", "4.2", "4.2.1"], ["40"]]


def test_pack_keeps_text_and_bound(spark):
    long = "y" * 1300 + "."
    cases = ["Curta.", " ".join(f"Frase número {i}." for i in range(400)), "a; " + long + " fim.", long]
    for text, pieces in zip(cases, values(spark, pack(F.col("c")), cases)):
        assert " ".join(pieces) == text
        for piece in pieces:
            assert len(piece) <= 1200 or len(re.split(r"(?<=[.;:])\s+", piece)) == 1
        for a, b in zip(pieces, pieces[1:]):
            assert len(a) + 1 + len(re.split(r"(?<=[.;:])\s+", b)[0]) > 1200
