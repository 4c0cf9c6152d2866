"""Personal data in sentences written by hand, which the training table's generator did not make."""

from siltstone.llm import personal

SENTENCES = [
    ("Dr. Weber can be reached at (415) 555-2671 after lunch", [("phone", "(415) 555-2671")]),
    ("Fax 212-555-0188 or ring 646.555.0199", [("phone", "212-555-0188"), ("phone", "646.555.0199")]),
    ("send the draft to maria (at) museum (dot) org please", [("email", "maria (at) museum (dot) org")]),
    ("Contact: JOHN [AT] library.net before Friday", [("email", "JOHN [AT] library.net")]),
    ("her new card is 4111.1111.1111.1111 valid till May", [("card", "4111.1111.1111.1111")]),
    ("The server answered from 10.20.30.40 within seconds", [("ip", "10.20.30.40")]),
    ("export API_KEY=9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", [("secret", "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b")]),
    ('config has token = "e3b0c44298fc1c149afbf4c8996fb924" inside', [("secret", "e3b0c44298fc1c149afbf4c8996fb924")]),
    ("In 1998 the company sold 12,450 units for $19.99 each", []),
    ("Meeting on 2021-04-17 at 10:30 in room 204", []),
    ("Chapter 12.4.1 lists 345 items, see page 88", []),
    ("The ratio was 3.14159 and the sum 1000000", []),
    ("Order 553201 left the depot at 07:45", []),
    ("Paragraph (3) of section 12 and note (at page 4)", []),
    ("We won 3-2, then 10-0, then lost 1-4", []),
    ("write to anna.b@post.example.org or call +44 20 7946 0958", [("email", "anna.b@post.example.org"), ("phone", "+44 20 7946 0958")]),
    ("password: q7Xw92LmZp04TtRk81vB", [("secret", "q7Xw92LmZp04TtRk81vB")]),
    ("the key to room 12b hangs by the door", []),
    ("ISBN and DOI apart, 20240101123456 is a time stamp", []),
    ("phone:(303) 555-0142, ask for Lee", [("phone", "(303) 555-0142")]),
]


def test_sentences_by_hand():
    emit, move = personal.trained()
    right = wrong = missed = 0
    for (text, want), (_, spans) in zip(SENTENCES, personal.found_spans([t for t, _ in SENTENCES], emit, move), strict=True):
        got = {(kind, text[a:b]) for a, b, kind in spans}
        right, wrong, missed = right + len(got & set(want)), wrong + len(got - set(want)), missed + len(set(want) - got)
    assert right / (right + wrong) >= 0.9 and right / (right + missed) >= 0.9


def test_secrets_are_only_of_the_field(spark):
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and card 4111 1111-1111 1111'
    r = personal.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in r.base_spans] == ["card"] and [s.kind for s in r.spans] == ["secret", "card"]
    assert text[r.spans[0].start : r.spans[0].end] == "04dbebab91ab85687d33eeaaf9ac699e1188f962"
