import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, size string"
WORDS = "the of and to in is that for it was with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state people those too mr how little good world make very year still see own work men day get here between both under never same another know while last might us great old go come since against right came take used himself few house use place american during without again home around small however found mrs part school thought went say general once upon every left war don does got united number hand course water until always away public something fact less though far put head think called set almost end enough government took night yet system better four nothing told eyes city going president why days present point didn look find asked second group later next room social business knew program give half side face toward white five let young form given per order large several national important rather seemed".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus():
    """Documents with copies, near copies, a shared passage, nulls, empties, odd white space and repeated rows."""
    rng = random.Random(5)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows = []
    for i in range(60):
        text = " ".join(sentence(rng, rng.randint(5, 15)) for _ in range(rng.randint(1, 12)))
        if i % 6 == 0:
            text = text + "\n" + passage + " " + text[::-1]
        rows.append([i, text, ["en", "de", None][i % 3], [f"s{i % 4}", None][i % 5 == 0], len(text)])
    rows.append([60, rows[3][1], "en", "s0", 1])
    rows.append([61, rows[3][1], "en", "s1", 1])
    near = rows[12][1].split(" ")
    near[7] = "changed"
    rows.append([62, " ".join(near), "en", "s1", 1])
    rows.append([63, "", "en", "s1", 0])
    rows.append([64, None, None, None, None])
    rows.append([65, "one", "en", "s9", 3])
    rows.append([66, "\t two\x0bwords here \r\n", "fr", "s9", 3])
    rows.append([67, "é" * 3000 + "ab" * 900, "fr", "s9", 3])
    rows.append([68, "loop " * 90, "en", "s2", 3])
    rows.append([69, " ".join(sentence(rng, 12) for _ in range(900)), "en", "s2", 3])
    rows.append([70, rows[3][1], "en", "s0", 1])
    rows.append([70, rows[3][1], "en", "s0", 1])
    rows.append([None, "no id at all " * 4, "en", "s0", 1])
    return [(*r, "clash", "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1] or "") for r in corpus()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
