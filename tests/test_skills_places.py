import random
import re

import pytest
from pyspark.sql import functions as F

from hiresift.dims import AMBIGUOUS, DEFAULT, HINTS, PHONE, Dims
from hiresift.functions import places, resume, skills
from tests.helpers import column


# (text, skill, whether it is found)
DETECTED = [
    ("On Fridays we go home early", "go", False), ("Ready, set, go live", "go", False), ("Compilers in Go and Zig", "go", True),
    ("golang services at night", "go", True), ("Languages: Go; Kotlin", "go", True),
    ("Meet us in room R2 on the first floor", "r", False), ("Tools: R, Stata", "r", True), ("plots in R or Excel", "r", True),
    ("Embedded C++ on small boards", "c++", True), ("ten years of C# in one shop", "c#", True),
    ("JavaScript for maps", "java", False), ("JavaScript for maps", "javascript", True), ("an island called Java", "java", True),
    ("travel agents in spring", "agents", False), ("an LLM agents platform", "agents", True),
    ("a ray of light", "ray", False), ("clusters with Ray Serve", "ray", True),
    ("every node of a tree", "node", False), ("servers in node.js", "node", True), ("nightly Apache Spark jobs", "apache spark", True),
    ("AWS Lambda, then GitHub Actions", "aws", True), ("AWS Lambda, then GitHub Actions", "aws lambda", True),
    ("AWS Lambda, then GitHub Actions", "github", True), ("power  bi", "power bi", False), ("GİT, Keras", "git", True), ("GİT, Keras", "keras", True),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [*dict.fromkeys(t for t, _, _ in DETECTED), "", None]
    got = column(spark, [(t,) for t in texts], "x string", lambda: skills.extract_skills(F.col("x")))
    return dict(zip(texts, got))


@pytest.mark.parametrize("text,skill,expected", DETECTED)
def test_detection(found, text, skill, expected):
    assert (skill in found[text]) is expected


def test_no_text_no_skills(found):
    assert found[""] == [] and found[None] == []


def test_hints_lose_no_context(spark):
    rng = random.Random(13)
    some = ["Go", "go", "GO", "golang", "GoLang", "R", "r", "R2", "Ray", "ray", "serve", "LLM", "agents", "AGENTIC", "agent", "framework", "Node", "node", "node.js", "NodeJS", "js",
            "developer", "in", "with", "and", "language", "to", ",", ", ", ";", "/", "(", ")", ".", " ", " ", "\u00a0", "\n", "\t", "é", "x"]
    texts = [("".join(rng.choice(some) for _ in range(rng.randint(1, 9))),) for _ in range(3000)]
    never = Dims(ambiguous={s: [*ps, "(?!)"] for s, ps in AMBIGUOUS.items()})  # other patterns, so no hints
    for skill in AMBIGUOUS:
        fast, plain = (column(spark, texts, "x string", lambda d=d: skills.hits_context(F.col("x"), skill, d)) for d in (DEFAULT, never))
        assert fast == plain and any(fast)
    assert set(HINTS) == set(AMBIGUOUS)


def test_one_scan_equals_one_regex_per_skill(spark):
    rng = random.Random(7)
    words = ["aws", "AWS", "lambda", "s3", "azure", "ml", "github", "actions", "ci/cd", "a/b", "testing", "c++", "c", "git",
             "machine", "learning", "online", "deep", "é", "data", "lake", "delta", "weights", "and", "biases", "xgboost"]
    seps = [" ", " ", "  ", ",", "-", "+", "#", "/", "_", ".", "\n", ""]
    texts = ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    got = column(spark, [(t,) for t in texts], "x string", lambda: skills.extract_skills(F.col("x")))
    plain = [s for s in DEFAULT.skills if s not in DEFAULT.ambiguous]
    amb = {s: [re.compile(p, re.MULTILINE) for p in ps] for s, ps in DEFAULT.ambiguous.items()}
    for text, hits in zip(texts, got):
        want = {s for s in plain if re.search(rf"(?<![\w+#]){re.escape(s)}(?![\w+#])", text, re.IGNORECASE)}
        want |= {s for s, ps in amb.items() if any(p.search(text) for p in ps)}
        assert hits == [s for s in DEFAULT.skills if s in want], text


def test_vocabulary_is_a_parameter(spark, tmp_path):
    path = tmp_path / "skills.txt"
    path.write_text("Cobol\nfortran\n\ncobol\n", encoding="utf-8")
    dims = Dims().with_skills(path)
    assert dims.skills == ["cobol", "fortran"]
    got = column(spark, [("Fortran, COBOL and python",)], "x string", lambda: skills.extract_skills(F.col("x"), dims))
    assert got == [["cobol", "fortran"]]


def test_synonyms_lead_into_the_vocabulary():
    assert set(DEFAULT.synonyms.values()) <= set(DEFAULT.skills)
    assert len(DEFAULT.skills) == len(set(DEFAULT.skills))


@pytest.mark.parametrize("raw,expected", [
    ("JS", "javascript"), ("  Node.js ", "node"), ("Weights  &\tBiases", "weights and biases"), ("cobol", "cobol"),
])
def test_normalize_skill(spark, raw, expected):
    assert column(spark, [(raw,)], "x string", lambda: skills.normalize_skill(F.col("x"))) == [expected]


def test_normalize_skills_keeps_first(spark):
    got = column(spark, [("ml, JS,,Python, machine learning, javascript ,python",)], "x string",
                 lambda: skills.normalize_skills(skills.split_list(F.col("x"))))
    assert got == [["machine learning", "javascript", "python"]]


@pytest.mark.parametrize("user,required,pct,matched,missing", [
    (["u", "v", "w"], ["u", "v", "w", "x"], 75, ["u", "v", "w"], ["x"]), (["z"], ["u"], 0, [], ["u"]), (["u"], [], 0, [], []),
    (["v"], ["u", "v", "w"], 33, ["v"], ["u", "w"]), (["a"], list("abcdefgh"), 12, ["a"], list("bcdefgh")),
    (list("abc"), list("abcdefgh"), 38, list("abc"), list("defgh")),
])
def test_match_score(spark, user, required, pct, matched, missing):
    got = column(spark, [(user, required)], "u array<string>, r array<string>",
                 lambda: skills.match_score(F.col("u"), F.col("r")))[0]
    assert (got.pct, got.matched, got.missing) == (pct, matched, missing)


@pytest.mark.parametrize("text,have,required,nice", [
    ("You bring Scala and Kafka. Good to have: Terraform, Redis.", ["scala", "kafka", "terraform", "redis"], ["scala", "kafka"], ["terraform", "redis"]),
    ("Your days are full of Rust. Some GraphQL would be great.", ["rust", "graphql"], ["rust"], ["graphql"]),
    ("Our stack is MongoDB with Flask.", ["mongodb", "flask"], ["mongodb", "flask"], []),
    ("Desirable: Tableau", ["tableau"], ["tableau"], []),
    ("Excel every day. Preferred skills: Excel", ["excel"], ["excel"], []),
    ("", ["rust"], ["rust"], []), (None, ["rust"], ["rust"], []), ("Bonus: x", [], [], []),
    ("Flask. Undesirable: Redis", ["flask", "redis"], ["flask"], ["redis"]),
    ("Rust! Go; would be great. Flask is a plus; Redis", ["rust", "flask", "redis"], ["rust", "redis"], ["flask"]),
])
def test_split(spark, text, have, required, nice):
    got = column(spark, [(text, have)], "d string, s array<string>",
                 lambda: skills.split_required_nice(F.col("d"), F.col("s")))[0]
    assert (got.required, got.nice) == (required, nice)


@pytest.mark.parametrize("loc,query,kind,include,expected", [
    ("Lugano, Ticino", "America", "", True, False), ("Basel", "USA", "", True, False), ("Boston, MA", "united states", "", True, True),
    ("Tulsa, OK", "us", "", True, True), ("Somewhere, ok", "us", "", True, False), ("Denver or remote", "U.S.", "", True, True),
    ("Anywhere in Spain", "Portugal", "", True, False), ("Pune, Maharashtra", "india", "", True, True),
    ("Leeds / England", "GB", "", True, True), ("Glasgow", "Great Britain", "", True, True), ("Köln", "Deutschland", "", True, True),
    ("Hamburg", "ham", "", True, True), ("Hamburg", "burg", "", True, False), ("", "Italy", "", True, False),
    ("Wien", "", "", True, True), ("Worldwide", "Japan", "", True, True), ("Worldwide", "Japan", "", False, False),
    ("", "Japan", "remote", True, True), ("Wien", "Japan", "remote", True, False), ("Worldwide", "Remote", "", True, True),
    ("Wien", "remote", " REMOTE ", True, True), ("Wien", "anywhere", "", True, False), (None, "日本", "", True, True), (None, "Oslo", "", True, False),
])
def test_location(spark, loc, query, kind, include, expected):
    got = column(spark, [(loc, kind)], "l string, k string",
                 lambda: places.location_matches(F.col("l"), query, F.col("k"), include))
    assert got == [expected]


def test_countries(spark):
    rows = [("Lausanne, Vaud",), ("Berlin, Paris or New Delhi",), ("Dublin, CA",), ("Nowhere, CA",), ("X, IN",), ("X, Cal",), (None,)]
    got = column(spark, rows, "l string", lambda: places.countries_in(F.col("l")))
    assert got == [["ch"], ["de", "fr", "in"], ["ie"], ["us"], ["us"], [], []]


RESUME = "Curriculum Vitae\n  Ana Lima \nana.lima@mail.example.org\n+(555) 123-4567\n5+ years of experience\nM.Sc Physics, PhD\nPython"


def test_resume_record(spark):
    got = column(spark, [(RESUME,), ("",), ("Interned at X. experience of 3 years",), ("Internal auditor",), ("1 yr",)],
                 "x string", lambda: resume.resume_record(F.col("x")))
    first = got[0].asDict()
    assert first == {"name": "Ana Lima", "email": "ana.lima@mail.example.org", "phone": "+(555) 123-4567", "skills": ["python"],
                     "skills_str": "python", "experience_years": 5, "education": ["m.sc", "phd"]}
    assert [r.experience_years for r in got] == [5, 1, 3, 0, 1]
    assert got[1].name == "Unknown" and got[1].email == "Not found" and got[1].phone == "Not found"
    assert re.search(PHONE, RESUME).group(0) == first["phone"]


def test_claims(spark):
    text = "We improved sales by 20 % and 10k users at Acme; your mission. [Name] [x] 300 requests per second"
    flags, n, words = column(spark, [(text,)], "x string", lambda: F.struct(
        resume.claim_flags(F.col("x")), resume.placeholder_count(F.col("x")), resume.word_count(F.col("x"))))[0]
    assert [f.split(":")[0] for f in flags] == ["percentage", "big number (10k, 2m)", "performance claim", "achievement verb",
                                               "fake employer", "company claim"]
    assert (n, words) == (2, len(text.split()))


def test_keyword_context(spark):
    text = "x" * 60 + "😀 we write\nin Go, and more " + "y" * 60
    got = column(spark, [(text,), ("go home",)], "x string",
                 lambda: resume.keyword_context(F.col("x"), DEFAULT.ambiguous["go"]))
    pattern = next(p for p in DEFAULT.ambiguous["go"] if re.search(p, text, re.MULTILINE))
    m = re.search(pattern, text, re.MULTILINE)
    assert got == [text[max(0, m.start() - 40):m.end() + 40].replace("\n", " "), None]


def test_few_skills_are_found_as_the_scan_finds_them(spark):
    """``present`` against ``extract_skills``, and the split against both scans, on texts made of vocabulary items and what stands around them."""
    rng = random.Random(3)
    items = [*DEFAULT.skills, "Go language", "node.js", "R, ", "Kafka\u017f", "C++", "javascripts", "Golang", "(R)", "ray tune"]
    glue = [" ", ", ", "", "x", ". ", "! ", "+", "-", " would be great. ", " Nice to have: ", "desirable", "\n", "\u0130"]
    rows = [("".join(rng.choice(items).upper() if rng.random() < .2 else rng.choice(items) if rng.random() < .6 else rng.choice(glue) for _ in range(25)),
             rng.sample(list(DEFAULT.skills), 12) + list(DEFAULT.ambiguous)) for _ in range(300)]
    rows = [(t, list(dict.fromkeys(have))) for t, have in rows]
    df = spark.createDataFrame(rows, "d string, s array<string>")
    out = df.select(skills.present(F.col("s"), F.col("d")).alias("a"), F.array_intersect("s", skills.extract_skills(F.col("d"))).alias("b"),
                    skills.may_hold(F.col("s"), F.col("d")).alias("may")).collect()
    assert all(r.a == r.b for r in out) and sum(len(r.a) for r in out) > 30
    assert all(r.may for r in out if r.a)
    assert not spark.createDataFrame([("the river runs", ["python", "sql"])], "d string, s array<string>").select(skills.may_hold(F.col("s"), F.col("d"))).first()[0]
