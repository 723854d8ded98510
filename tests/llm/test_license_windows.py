"""Licences inside longer lines, across line ends and as full texts."""

import random
import time
from collections import Counter

from tillhouse.llm.license_scan import PERCENT, TEMPLATES, WORD, Scanner, bodies, scan_licenses

MPL = "This Source Code Form is subject to the terms of\nthe Mozilla Public\nLicense, v. 2.0."


def test_notices_in_paragraphs_wrapped_headers_and_bodies(spark):
    rows = [(0, f"{'some words before it ' * 30}. Released under the MIT License. {'and after ' * 40}", "MIT", 1.0)]
    rows.append((1, f"first lines\n\n{MPL}\n\n{'int x = 1; ' * 50}", "MPL-2.0", 1.0))
    for name, body in bodies():
        rows.append((len(rows), f"{'not a licence ' * 100}\n{body}\n{'code of all kinds ' * 100}", name, 0.99))
    rows.append((len(rows), "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 1.0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    got = {(r.doc_id, r.license): r for r in scan_licenses(docs).collect()}
    for i, _, name, dice in rows:
        assert got[i, name].dice >= dice, (i, name)
    assert [k for k in got if k[0] in (0, 1, len(rows) - 1)] and got[0, "MIT"].n_units == 1
    assert {name for i, name in got if i == len(rows) - 1} == {"CC-BY-NC-4.0"}


def test_best_windows_against_all_windows():
    rng = random.Random(5)
    templates = (("A", "a b c a b d"), ("B", "x a b b b c y"))
    scanner = Scanner(templates, PERCENT)
    for _ in range(300):
        words = [rng.choice("abcdxyz") for _ in range(rng.randint(2, 25))]
        found = scanner.numbers(words)
        for t, (_, body) in enumerate(templates):
            grams = Counter(zip(WORD.findall(body), WORD.findall(body)[1:]))
            m = sum(grams.values())
            dice = [
                2 * (Counter(zip(words[i:j], words[i + 1 : j])) & grams).total() / (j - i - 1 + m)
                for i in range(len(words)) for j in range(i + 2, len(words) + 1)
            ]
            own = scanner.windows(found, t)
            assert max([d for d in dice if d >= PERCENT / 100], default=0) == max([d for d, *_ in own], default=0)
            taken = [k for _, a, b in own for k in range(a, b + 2)]
            assert len(taken) == len(set(taken))
    assert len(TEMPLATES) == 15


def test_time_grows_with_the_text():
    scanner = Scanner([*TEMPLATES, *bodies()], PERCENT)
    notice = TEMPLATES[1][1] + "\nplain words between\n"

    def seconds(times):
        text = notice * times
        started = time.process_time()
        assert {name for _, name, _ in scanner.scan(text)} == {"Apache-2.0"}
        return time.process_time() - started

    seconds(50)
    assert seconds(3200) < 12 * seconds(800)
