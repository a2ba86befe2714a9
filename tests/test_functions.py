import random
import time

import pytest
from pyspark.sql import functions as F

from inkwell.functions import autolatex, chem, mathtext, runs
from inkwell.functions import predicates as P
from inkwell.functions import spans as S
from inkwell.functions.latex import readable, to_readable

CHEM = {
    "K 2 CrO 4": "K₂CrO₄", "PbI 2 (s) , then": "PbI₂(s), then", "Mg 3 (PO 4 ) 2": "Mg₃(PO₄)₂", "v = k [HI] 2 [Br 2 ]": "v = k[HI]²[Br₂]", "[N 2 O 4 ] 0": "[N₂ O₄]₀",
    "Sn 4+ or NO 3-": "Sn⁴⁺ or NO³⁻", "PO 4 3-": "PO₄³⁻", "P 4 + Cl 2 → PCl 3": "P₄ + Cl₂ → PCl₃", "At 5 bar": None, "Room 14 has": None, "I 2 am": None, "eq 3": None, "7 8": None, "x\ty": None, "": None, "  ": None,
}
ATTACHED = {"(PCl5)": "(PCl₅)", "K2Cr2O7.": "K₂Cr₂O₇.", "3CO2(aq)": "3CO₂(aq)", "[Fe2O3]": "[Fe₂O₃]", "Mg(OH)2": "Mg(OH)₂", "GATE2019": None, "CBSE12": None, "Part3": None, "As4 of 10": None}
MATH = {
    "∫_{1}^{e} g(t).dt": r"\int_{1}^{e} g(t)\,dt", "(sqrt(cosx))/(3)": r"\frac{\sqrt{\cos x}}{3}", "h(x)={4x, if h(x)=g(x) 7, if h(x)= -g(x)": r"h(x) = \begin{cases} 4x & \text{if } h(x)=g(x) \\ 7 & \text{if } h(x)=-g(x) \end{cases}",
    "u={3 if h (t)is odd 5, if h (t) are even hence": r"u = \begin{cases} 3 & \text{if } h(t)\text{ is odd} \\ 5 & \text{if } h(t)\text{ are even} \end{cases} hence", "tantan y": r"\tan y", "arcsin z": r"\arcsin z", "\\cosec\u2061 y": r"\csc y",
    "a³ − b₂": "a^{3} − b_{2}", "sqrt(sqrt(m)": "sqrt(sqrt(m)", "p ___ q": r"p\_\_\_ q", r"\text{so  dx}": r"\text{so  dx}", "x \\,dx": r"x \,dx", "1 ≤ n – 2": r"1 \le n - 2", "": "",
}
AUTO = {
    "k_B": "$k_{B}$", "NO₃⁻ ion": "$NO_{3}^{-}$ ion", "√(m+1) or √7": r"$\sqrt{m+1}$ or $\sqrt{7}$", "coscos u": r"$\cos{u}$", "(p)/(q)": r"$\frac{p}{q}$", "root(4, w)": r"$\sqrt[4]{w}$", "sqrt(ab)": r"$\sqrt{ab}$",
    "∫_{1}^{μ} h": r"$\int_{1}^{\mu }$ h", "m^{p}": "$m^{p}$", "m³": "$m^{3}$", "t2g4": "$t_{2g}^{4}$", "eg2": "$e_g^{2}$", "tan 3y": r"$\tan{3y}$", "Δo": r"$\Delta_{o}$", "ρ": r"$\rho$", "g(z)": "$g(z)$", "6.6 x 10-34": r"$6.6 \times 10^{-34}$",
    "10-7 m": "$10^{-7}$ m", "3y4": "$3y^{4}$", "dm-3": "$dm^{-3}$", "page-3": "page-3", "4s1": "$4s^{1}$", "f7 ion": "$f^{7}$ ion", "[Fe(CN)6]3-": "$[Fe(CN)_{6}]^{3-}$", "HNO3": "$HNO_{3}$", "Zn2+ here": "$Zn^{2+}$ here", r"\vec{p}": r"$\vec{p}$",
    "$r$ = 2x": "$r = 2x$", "no maths here": "no maths here", "": "",
}


def column(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(3)
    return [r.o for r in rows.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]


def test_chem(spark):
    rows = chem.with_chem(spark.createDataFrame([*((t,) for t in CHEM), (None,)], "t string").withColumn("raw", F.col("t")), "t").collect()
    assert {r.raw: r.t for r in rows} == {k: v or k for k, v in CHEM.items()} | {None: None}
    assert all(chem.repaired(v or k) == (v or k) for k, v in CHEM.items())
    assert column(spark, chem.attached_subscripts, ATTACHED) == [v or k for k, v in ATTACHED.items()]
    assert column(spark, chem.concentrations, ["\\ln [X 1 ]", None]) == ["\\ln [X_{1}]", None]
    got = column(spark, chem.markup_runs, ["p<sub>3</sub>q<sup>-</sup>", "y"])
    assert [tuple(r) for r in got[0]] == [("p", "normal"), ("3", "subscript"), ("q", "normal"), ("-", "superscript")] and len(got[1]) == 1
    long = "Na" * 3_000 + "2"  # no length is too much
    assert chem.formula(long) and column(spark, P.is_formula, [long, long + "q"]) == [True, False]
    assert chem.repaired("H 2 " * 5_000).startswith("H₂ H₂") or chem.repaired("H 2 " * 5_000).startswith("H₂H₂")


def test_math(spark):
    got = column(spark, lambda t: mathtext.convert_math(F.array(t)), MATH)
    assert [x[0] for x in got] == list(MATH.values())
    again = column(spark, lambda t: mathtext.convert_math(F.array(t)), MATH.values())
    assert [x[0] for x in again] == list(MATH.values())
    flags = column(spark, mathtext.check_math, [r"\int_{1}^{b} \frac{1}{y}", r"\int_{2}^{{3}}\,dt", r"\sqrt{a", r"\int y\,dt", r"\end{cases} a", r"\int^{3}_{2}\,dx", None])
    assert flags[:5] == [["1 integral sign(s) but 0 differential(s)"], ["integral with empty integrand"], ["unbalanced braces"], [], ["begin/end mismatch"]] and flags[5] == []
    assert column(spark, mathtext.issue, ["y_{3}", "y_{ }", "y_ ", "y}", "$y", r"\end{x}", None]) == [None, "empty script", "dangling script", "unbalanced braces", "dollar sign", "environment mismatch", None]


def test_runs(spark):
    q = r"Show$∫_{0}^{2} g(t)dt=4 $ so that $(sin^{3}t)/(4)$ dt (2018,2021-1)"
    want = [("TEXT", "Show"), ("MATH", "∫_{0}^{2} g(t)dt=4"), ("TEXT", " so that "), ("MATH", "(sin^{3}t)/(4) dt")]
    (got,) = column(spark, mathtext.split_runs, [q])
    assert got.tag == "2018,2021-1" and [tuple(r) for r in got.runs] == want and runs.split_auto(q) == (got.tag, want)
    assert runs.split_auto("Let us see ∫ t^{5} dt = (2022M)") == ("2022M", [("TEXT", "Let us see "), ("MATH", "∫ t^{5} dt =")])
    assert runs.split_unmarked("9. Given ∫ cost dt.") == [("TEXT", "9. Given "), ("MATH", "∫ cost dt"), ("TEXT", ".")]
    assert runs.split_unmarked("slope of m = n^{3} near zero") == [("TEXT", "slope of "), ("MATH", "m = n^{3}"), ("TEXT", " near zero")]
    for t in ["tant-K", "(m)/(3)", "\\sec^{2}u"]:
        assert runs.split_unmarked(t) == [("MATH", t)]
    for t in ["7", "the limit does exist", "when the sum is odd", "Speed = [P][Q] 3", "[S 1 ]", "Neither (c) nor (d)", "SO2 + Cl2", "ii and iv", " "]:
        assert runs.split_unmarked(t) == [("TEXT", t)], t
    assert runs.merge_runs([("MATH", "∫ t dt"), ("TEXT", " +")]) == [("MATH", "∫ t dt +")]
    assert runs.merge_runs([("TEXT", "Take 5 - "), ("MATH", "t")]) == [("TEXT", "Take "), ("MATH", "5 - t")]
    assert runs.merge_runs([("MATH", "p"), ("TEXT", "  "), ("MATH", "q")]) == [("MATH", "p q")] and runs.merge_runs([]) == []
    assert runs.merge_runs([("MATH", "p"), ("TEXT", " = 2, so"), ("TEXT", " ")]) == [("MATH", "p = 2"), ("TEXT", ", so ")]
    for same in ([("TEXT", "Take "), ("MATH", "m"), ("TEXT", " or "), ("MATH", "n"), ("TEXT", " where ")], [("TEXT", "If "), ("MATH", "p"), ("TEXT", "; "), ("MATH", "q")], [("MATH", "m"), ("TEXT", " (b) holds")]):
        assert runs.merge_runs(same) == same
    assert column(spark, runs.runs_of, [None])[0] is None
    rows = [(1, None, {"A": "1", "B": "∫ (1)/(t)dt = (2024M)"}), (2, None, {"C": "t + k (2023-2)", "D": None}), (3, "2020", {"A": "u (2019)"}), (4, "2011", None), (5, None, {})]
    tags = spark.createDataFrame(rows, "i int, tag string, o map<string,string>").select("i", runs.option_tags(F.col("tag"), F.col("o")).alias("r")).orderBy("i").collect()
    assert [(r.r.tag, r.r.options, r.r.swallowed) for r in tags] == [(None, rows[0][2], ["B"]), ("2023-2", {"C": "t + k", "D": None}, []), ("2020", {"A": "u"}, []), ("2011", None, None), (None, {}, [])]


@pytest.mark.parametrize(("raw", "want"), AUTO.items())
def test_auto_latex(raw, want):
    assert autolatex.auto_latex(raw) == want


def test_auto_latex_of_anything(spark):
    rng = random.Random(6)
    bits = ["x", "2", "Na", "(", ")", "/", "{", "}", "^", "_", "$", "√", "∫", "²", "₃", "Δo", "sin", " ", "10-3", "[", "]", "+", "\\", "and", "\ue000"]
    for _ in range(3_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))
        assert isinstance(autolatex.auto_latex(t), str) and isinstance(to_readable(t), str)
    assert autolatex.auto_latex("word " * 50_000).count("word") == 50_000
    assert column(spark, autolatex.auto_latex_column, [None, "", "k_B"]) == [None, "", "$k_{B}$"]


def test_readable():
    cases = {"10⁴ N": None, r"\vec{a}=m\hat{b}": "a⃗=mb̂", r"\frac{p-1}{\sqrt{q}} \geq r^{4}": "(p-1)/(√(q)) ≥ r⁴", r"\sqrt[5]{t_{2}": "sqrt[5](t₂", r"t_{ab} u_{a+b} v^{n}": "t_ab u_(a+b) v^(n)", r"\begin{cases} 1 & a \\ 2 & b \end{cases}": "1 a ; 2 b", r"\left( \lambda \right)": "( λ )", r"\text{so} \foo{k}": "so foo(k)", "": ""}
    for raw, want in cases.items():
        assert readable(raw) == (raw if want is None else want)
    assert readable("\\frac{" * 5_000 + "x").startswith("frac(frac(") and readable("{" * 20_000 + "}" * 20_000) == "(" * 20_000 + ")" * 20_000
    assert to_readable(None) is None and to_readable("m² and k_B") == "m² and k_B"


HEADERS = {"Section D": True, "Part C: Waves": True, "Roots and Stems of Plants": True, "3 marks": True, "List-II": False, "IV": False, "NOTE": False, "Statement 2": False, "2. How": False, "(C) None": False, "Solve the Equation": False, "Why Is It?": False, "": False, "a → B": False, "x" * 90: False, "Chemistry": True}
NUMBERS = {"4. Why": ("main", "4"), "Q012) y": ("main", "12"), "Question 9: z": ("main", "9"), "0.25 of": None, "7.5 kg": None, "(vi) item": ("subpart", "vi"), "8(c) y": ("subpart", "c"), "IV. Find": ("roman", "IV"), "vii. y": ("roman", "VII"), "": None, "Text": None, "31 - y": ("main", "31"), "9" * 30 + ". y": ("main", "9" * 30), "000) z": ("main", "0")}
TAGS = {"5. y (2016) (2013)": (["2016", "2013"], "5. y"), "p [2011, 2015M] q": (["2011", "2015M"], "p  q"), "g (3 + 2018)": ([], "g (3 + 2018)"), "(AIEEE 2012, set B)": (["AIEEE 2012, set B"], ""), "nothing": ([], "nothing"), "(2014,2016)": (["2014", "2016"], "")}


def test_predicates(spark):
    assert column(spark, P.is_section_header, HEADERS) == list(HEADERS.values())
    assert [(n.kind, n.value) if n else None for n in column(spark, P.question_number, NUMBERS)] == list(NUMBERS.values())
    assert list(zip(column(spark, S.appearances, TAGS), column(spark, S.without_citations, TAGS), strict=True)) == list(TAGS.values())
    heads = {"Answers": True, "Case Based Problems:": True, "p and D Block metals:": True, "Here is a long line which is no heading": False, "(B) Here is": False, "diffusion": False, "so the leaf dries.": False}
    assert column(spark, P.is_heading, heads) == list(heads.values())
    assert [tuple(x) for x in column(spark, P.trailing_heading, ["nine Modern Optics:", "none at all", "Alone:"])] == [("nine", "Modern Optics"), ("none at all", None), ("Alone:", None)]
    formulas = {"CO2": True, "3SO(l)": True, "As": False, "Qrs": False, "KBr": True, "": False, "Coo": False, "COo": False}
    assert column(spark, P.is_formula, formulas) == list(formulas.values())
    assert column(spark, P.is_question_like, ["Prove y", "$y$", "an", "", "____ are"]) == [True, True, False, False, True]
    assert [tuple(x) for x in column(spark, S.citation, ["How? (2017M).", "B (2014) c", "nil"])] == [("How?", "(2017M)"), ("B c", "(2014)"), ("nil", None)]
    (m,) = column(spark, S.match_columns, ["Pair: Column I (Name) Column II (Sign) (1) Iron (2) Tin (a) Sn (b) Fe"])
    assert (m.intro, m.left_label, m.right_label, m.left, m.right) == ("Pair", "Name", "Sign", ["(1)  Iron", "(2)  Tin"], ["(a)  Sn", "(b)  Fe"])
    assert column(spark, S.fold_math_letters, ["𝑀𝑧 ³₄¼"]) == ["Mz ³₄¼"]
    assert column(spark, S.inline_parts, ["(a) 5 kg (b) 6 (c) 7 (d) 8", "(B) two", "y (B) two", "bare"]) == [["(a) 5 kg", "(b) 6", "(c) 7", "(d) 8"], ["(B) two"], ["y", "(B) two"], ["bare"]]


@pytest.mark.parametrize("t", [None])
def test_nulls(spark, t):
    for f in (P.is_section_header, P.question_number, P.is_heading, S.appearances, S.without_citations, chem.attached_subscripts, P.is_formula):
        assert column(spark, f, [t, "x"])[0] in (None, False)


def test_brackets_that_nothing_closes(spark):
    texts = ["(2014) " + "( [ " * 250_000 + "(2015", "( [ x (2016) ] y", "a [2017 (b) c", "[ (2018) ( ] (", None]
    begin = time.perf_counter()
    got = column(spark, lambda t: F.struct(S.appearances(t).alias("a"), S.without_citations(t).alias("w")), texts)
    assert time.perf_counter() - begin < 60  # a few seconds where nothing else runs
    assert got[0].a == ["2014"] and got[0].w == ("( [ " * 250_000 + "(2015")
    assert (got[1].a, got[1].w) == (["[ x (2016"], "] y") and (got[2].a, got[2].w) == ([], "a [2017 (b) c") and (got[3].a, got[3].w) == (["(2018) ("], "(")
