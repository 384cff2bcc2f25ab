import pytest

from lodestone.llm import licenses

MIT = licenses.TEMPLATES["MIT"][4]


def brute(template, text):
    """Least edits between a template and any part of a text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, t in enumerate(template, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (t != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("change", [lambda w: w, lambda w: w[:40] + w[42:], lambda w: w[:30] + ["extra", "words"] + w[30:], lambda w: ["other" if i % 17 == 0 else x for i, x in enumerate(w)]])
def test_alignment_equals_full_table(change):
    index = licenses.Index({"MIT": [MIT]})
    _, _, template = index.templates[0]
    text = ["before", "it"] + change(licenses.words(MIT)) + ["after"]
    ids = [index.number.get(w, -1 - i) for i, w in enumerate(text)]
    matched, first, last, edits = licenses.align(template, ids, band=8, offset=2)
    assert edits == brute(template, ids)
    assert matched >= len(template) - edits and 0 <= first < last <= len(text)


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, license string, start int")
    return sorted((r["doc_id"], r["license"], r["start"], r["end"], r["matched_words"]) for r in licenses.scan(docs).collect())


def test_scan(spark):
    texts = [
        "é prose. Released under the MIT License. more", "Licensed under CC BY-NC 4.0.", None, "", "the software and the rights of any person to deal in the cup without charge",
        MIT.replace("granted", "given").upper(), "Released under the MIT License\n" * 3, "a " * 70_000 + "This work is licensed under the GNU General Public License, version 3.",
    ]
    got = found(spark, texts)
    assert got[0] == (0, "MIT", 9, 39, 5)
    assert (1, "CC-BY-NC-4.0", 0, 27, 7) in got and not any(r[0] == 1 and r[1] != "CC-BY-NC-4.0" for r in got)
    assert not any(r[0] in (2, 3, 4) for r in got)
    (long,) = [r for r in got if r[0] == 5]
    assert long[1] == "MIT" and long[4] == len(licenses.words(MIT)) - 1
    assert [r[2] for r in got if r[0] == 6] == [0, 31, 62]
    assert [r[1:3] for r in got if r[0] == 7] == [("GPL-3.0", 140_000)]
    assert found(spark, []) == []


def test_winnowing_keeps_every_run_of_five_words():
    index = licenses.Index(licenses.TEMPLATES)
    for _, _, ids in index.templates:
        grams = index.grams(licenses.np.array(ids)).tolist()
        for a in range(len(ids) - 4):
            assert any(g in index.places for g in grams[a : a + 3])


def test_spans_are_those_of_the_text(spark):
    text = "\u0130\u0130\u0130 Released under the MIT License"
    assert found(spark, [text])[0][:4] == (0, "MIT", 4, 34) and text[4:34] == "Released under the MIT License"


def test_short_notices_in_a_row_and_kin(spark):
    kin = {n: licenses.TEMPLATES[n][-1] for n in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-2-Clause")}
    bsd3 = licenses.TEMPLATES["BSD-3-Clause"][2]
    got = found(spark, ["SPDX-License-Identifier: MIT\n" * 3, *kin.values(), bsd3, "SPDX-License-Identifier: MIT"])
    assert [r[2] for r in got if r[0] == 0] == [0, 29, 58]
    for i, (name, text) in enumerate(kin.items(), 1):
        assert [(r[1], r[2], r[3]) for r in got if r[0] == i] == [(name, 0, len(text.rstrip(".")))]
    assert [r[1] for r in got if r[0] == 7] == ["BSD-3-Clause"]


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "Licensed under CC BY 4.0"), (3, "Licensed under CC BY 4.0"), (3, "Licensed under CC BY 4.0"), (None, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["license"]) for r in licenses.scan(docs).collect()) == [(-1, "CC-BY-4.0"), (3, "CC-BY-4.0"), (3, "CC-BY-4.0")]
