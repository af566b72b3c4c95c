import pytest
from edges import docs

from paperloom.llm import pii

VALUES = {
    "(jane@mail.com)": ["jane@mail.com"],
    "(123-45-6789)": ["123-45-6789"],
    "(4694285338670649)": ["4694285338670649"],
    "(2024-01-05)": ["2024-01-05"],
    "(10.0.0.1)": ["10.0.0.1"],
    "to -jane@mail.com, .10.0.0.1 and id-123-45-6789": ["jane@mail.com", "10.0.0.1", "123-45-6789"],
    "10.0.0.1-10.0.0.9": ["10.0.0.1", "10.0.0.9"],
    "4694285338670649 123": ["4694285338670649"],
    "4694285338670649 12/27": ["4694285338670649"],
    "4694 2853 3867 0649 123": ["4694 2853 3867 0649"],
    "12 4694 2853 3867 0649": ["4694 2853 3867 0649"],
    "4694285338670649 01-05-2024": ["4694285338670649", "01-05-2024"],
    "4694285338670649 415 555 1234": ["4694285338670649", "415 555 1234"],
    "BE68 5390 0754 7034 CALL ME": ["BE68 5390 0754 7034"],
    "AB12 3456 4694 2853 3867 0649": ["4694 2853 3867 0649"],
    "BE68 5390 0754 7034 4111 1111 1111 1111": ["BE68 5390 0754 7034", "4111 1111 1111 1111"],
    "password: correcthorse": ["password: correcthorse"],
    "none 1.2.3.4.5 and 4694285338670648 stay": [],
}


@pytest.fixture(scope="module")
def got(spark):
    rows = docs(spark, [(i, t, "en", "s") for i, t in enumerate(VALUES)])
    return {list(VALUES)[r["_row"].doc_id]: r for r in pii.pseudonymize(rows).collect()}


@pytest.mark.parametrize("text", VALUES)
def test_values_in_any_place(got, text):
    row = got[text]
    assert [f.old for f in row.found] == VALUES[text]
    want = text
    for f in row.found:
        want = want.replace(f.old, f.new, 1)
    assert row["_row"].text == want
