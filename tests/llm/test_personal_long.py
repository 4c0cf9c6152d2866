"""Long sequences of op10: what is found does not depend on where in a run of tokens it is, nor on the case of at and dot."""

import pytest

from siltstone.llm import personal


@pytest.fixture(scope="module")
def models():
    return personal.trained()


def test_runs_are_decoded_whole(models, monkeypatch):
    phone = "tel 555-123-4567"
    want = (4, 16, "phone")
    texts = [f"{'7 ' * k}then call {phone} now" for k in range(235, 262)]
    for block in (32_768, 50):
        monkeypatch.setattr(personal, "BLOCK", block, raising=False)
        for text, (base, got) in zip(texts, personal.found_spans(texts, *models), strict=True):
            at = text.index(phone)
            assert not base and got == [(at + want[0], at + want[1], want[2])]


def test_at_and_dot_in_any_case(models):
    for what in ("jo.li (at) example (dot) com", "JO (AT) EXAMPLE (DOT) COM", "Jo [At] Example.com"):
        text = f"write to {what} when under the lamp"
        assert personal.windows(text) and personal.plausible("email", what)
        assert any(k == "email" for *_, k in personal.found_spans([text], *models)[0][1])
