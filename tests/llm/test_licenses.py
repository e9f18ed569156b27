import re

import pytest

from corpuslens.llm import licenses as L


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for i in range(len(w)):
        for phrase, label in L.BASE_PHRASES.items():
            p = phrase.split()
            if w[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_columns(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(900, None), (901, ""), (902, "CC BY-NC; cc by nc CC by  NC underthe mit license"), (903, "Under the MIT License\n" * 3), (904, "apache license, VERSION 2.0 É under the mit licenseé"), (904, "x"), (None, "cc by nc cc by nc by nc"), (905, "word " * 50_000 + "under the mit license")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, labels string")
    out = sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(df).collect()], key=str)
    assert out == sorted([(i, *brute(t)) for i, t in rows], key=str)
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_tags_and_score():
    s = L.Scanner(L.BASE_PHRASES, L.MORE_PHRASES, {"mit", "apache-2.0"})
    got = s.scan("/* SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 */\n# spdx-license-identifier: GPL-2.0+ WITH Classpath-exception-2.0\nİ SPDX-License-Identifier: MIT AND\n")
    assert got["labels"] == "apache-2,gpl-2,gpl-2 with classpath-exception-2.0,mit" and got["n_malformed"] == 1 and got["permitted"] is False and got["unknown"] == ""
    assert 0.9 < got["score"] <= 1 and s.scan("nothing")["score"] == 0 and s.scan("x")["permitted"] is None
    assert s.scan("SPDX-License-Identifier: MIT")["permitted"] is True


def test_unknown_identifiers_are_told_apart():
    s = L.Scanner(L.BASE_PHRASES, L.MORE_PHRASES, {"mit"})
    got = s.scan("SPDX-License-Identifier: see-readme")
    assert (got["labels"], got["score"], got["unknown"], got["expressions"]) == ("", 0, "see-readme", ["see-readme"])
    got = s.scan("SPDX-License-Identifier: MIT AND Foo-1.0 OR GPL-2.0-only WITH Bar-exception")
    assert (got["labels"], got["unknown"]) == ("gpl-2,mit", "bar-exception,foo-1.0") and got["score"] == pytest.approx(0.9)
    got = s.scan("SPDX-License-Identifier: LicenseRef-Own-2 AND DocumentRef-x:LicenseRef-y")
    assert (got["labels"], got["unknown"]) == ("documentref-x:licenseref-y,licenseref-own-2", "")
    assert s.scan("SPDX-License-Identifier: Classpath-exception-2.0")["unknown"] == "classpath-exception-2.0"  # an exception is no licence
    own = L.Scanner({}, {}, set(), known=["Foo-1.0"], exceptions=[])
    assert own.scan("SPDX-License-Identifier: foo-1.0 OR MIT")["labels"] == "foo-1" and own.scan("SPDX-License-Identifier: MIT")["unknown"] == "mit"


@pytest.mark.parametrize(
    ("phrase", "tag"),
    [("Apache License, Version 2.0", "Apache-2.0"), ("under the MIT License", "MIT"), ("CC BY-NC", "CC-BY-NC-4.0"), ("GNU General Public License version 3", "GPL-3.0-or-later"), ("GNU General Public License version 2", "GPL-2.0+"),
     ("GNU Affero General Public License", "AGPL-3.0-only"), ("Mozilla Public License, version 2.0", "MPL-2.0"), ("Boost Software License - Version 1.0", "BSL-1.0"), ("Eclipse Public License v 2.0", "EPL-2.0"),
     ("SIL Open Font License", "OFL-1.1"), ("CC0 1.0 Universal", "CC0-1.0"), ("GNU Lesser General Public License version 2.1", "LGPL-2.1-only")],
)
def test_phrase_and_tag_give_one_label(phrase, tag):
    s = L.Scanner(L.BASE_PHRASES, L.MORE_PHRASES, set())
    by_tag = s.scan(f"SPDX-License-Identifier: {tag}")["labels"]
    assert "," not in by_tag and by_tag in s.scan(phrase)["labels"].split(",")


def test_catalogue():
    assert len(L.IDENTIFIERS) < 200 and len({x.lower() for x in L.IDENTIFIERS}) == len(L.IDENTIFIERS)
    assert not {x.lower() for x in L.IDENTIFIERS} & {x.lower() for x in L.EXCEPTIONS}
    assert {L.canonical(x) for x in ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "gpl-2.0+")} == {"gpl-2"}


@pytest.mark.parametrize(("text", "allowed", "ok"), [("A OR B AND C", {"a"}, True), ("(A OR B) AND C", {"a"}, False), ("(A OR B) AND C", {"a", "c"}, True), ("A WITH E", {"a"}, False), ("A WITH E OR B", {"a with e"}, True), ("a and b or c", {"c"}, True)])
def test_expressions(text, allowed, ok):
    assert L.permits(L.to_postfix(text), allowed) is ok


@pytest.mark.parametrize("text", ["", "A B", "A OR", "AND A", "(A", "A)", "()", "A OR (AND B)", "A ? B"])
def test_malformed(text):
    with pytest.raises(L.ExpressionError):
        L.to_postfix(text)


def test_precedence():
    assert L.to_postfix("A OR B AND C WITH D") == ["A", "B", "C", "D", "WITH", "AND", "OR"]


def brute_score(text):
    """Labels and score by plain search and a recursive parser."""
    base_hits, labels, more, extra, good = 0, set(), set(), 0, 0
    known, exceptions = {x.lower() for x in L.IDENTIFIERS}, {x.lower() for x in L.EXCEPTIONS}
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    for phrases, is_base in ((L.BASE_PHRASES, True), (L.MORE_PHRASES, False)):
        for phrase, label in phrases.items():
            p = phrase.split()
            n = sum(w[i : i + len(p)] == p for i in range(len(w)))
            if n:
                (labels if is_base else more).add(label)
            base_hits, extra = base_hits + n * is_base, extra + n * (not is_base)
    for line in (text or "").split("\n"):
        for piece in re.split(r"(?i)spdx-license-identifier:", line)[1:]:
            piece = re.split(r"\*/|-->|#|//|\"|'", piece)[0]
            tokens = re.findall(r"[()]|[A-Za-z0-9.\-]+(?::[A-Za-z0-9.\-]+)?\+?|\S", piece)

            def simple():
                token = tokens.pop(0) if tokens else ")"
                if token == "(":
                    inner = either()
                    if not tokens or tokens.pop(0) != ")":
                        raise ValueError
                    return inner
                if not re.match(r"[A-Za-z0-9.\-]", token) or token.upper() in L.PRECEDENCE:
                    raise ValueError
                return [token.lower()], True

            def combined():
                names, plain = simple()
                while tokens and tokens[0].upper() == "WITH":
                    tokens.pop(0)
                    (exception, single) = simple()
                    if not plain or not single:
                        raise ValueError
                    names, plain = [f"{names[0]} {exception[0]}"], False
                return names, plain

            def both():
                names, plain = combined()
                while tokens and tokens[0].upper() == "AND":
                    tokens.pop(0)
                    names, plain = names + combined()[0], False
                return names, plain

            def either():
                names, plain = both()
                while tokens and tokens[0].upper() == "OR":
                    tokens.pop(0)
                    names, plain = names + both()[0], False
                return names, plain

            try:
                names, _ = either()
                if tokens:
                    raise ValueError
                labels_here = set()
                for name, _, exception in (n.partition(" ") for n in names):
                    if name.removesuffix("+") in known:
                        labels_here.add(L.canonical(name) + (f" with {exception}" if exception in exceptions else ""))
                more |= labels_here
                good += bool(labels_here)
            except ValueError:
                pass
    doubt = (1 - L.TAG_WEIGHT) ** min(good, 64) * (1 - L.BASE_WEIGHT) ** min(base_hits, 64) * (1 - L.MORE_WEIGHT) ** min(extra, 64)
    return ",".join(sorted(labels | more)), 1 - doubt


def test_labels_and_score_against_brute_force(spark, small):
    import random

    rng = random.Random(5)
    parts = ["MIT", "Apache-2.0", "(", ")", "AND", "or", "WITH", "GPL-2.0+", "x:y", " ", "  ", "#", "*/", "?", "\n", "SPDX-License-Identifier:", "spdx-license-identifier: ", "all rights reserved", "cc by nc", "Mozilla Public License, Version 2", "'"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(400)]
    texts += ["SPDX-License-Identifier: " + " ".join(rng.choices(["A", "B", "(", ")", "AND", "OR", "WITH"], k=rng.randrange(1, 8))) for _ in range(300)]
    texts += ["SPDX-License-Identifier: " + " ".join(rng.choices(["MIT", "GPL-2.0+", "(", ")", "AND", "OR", "WITH", "LLVM-exception", "Apache-2.0"], k=rng.randrange(1, 8))) for _ in range(600)]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    scanner = L.Scanner(L.BASE_PHRASES, L.MORE_PHRASES, {"mit"})
    for t in texts:
        got, (labels, score) = scanner.scan(t), brute_score(t)
        assert got["labels"] == labels and abs(got["score"] - score) < 1e-12, t
    assert sum(bool(scanner.scan(t)["expressions"]) for t in texts) >= 40


def test_very_long_lines_take_linear_time():
    import time

    scanner = L.Scanner(L.BASE_PHRASES, L.MORE_PHRASES, {"mit"})
    tag = "SPDX-License-Identifier: "
    for text in ((tag + "MIT ") * 35_000, tag + " " * 1_000_000, tag + "MIT" + " " * 1_000_000 + "?", tag + " AND ".join(["MIT"] * 120_000), tag + " WITH ".join(["a"] * 120_000), tag + "(" * 500_000, tag + "a AND (" * 120_000 + "b" + ")" * 120_000):
        began = time.process_time()
        scanner.scan(text)
        assert time.process_time() - began < 3, text[:60]
    assert scanner.scan((tag + "MIT ") * 35_000)["n_malformed"] == 0
