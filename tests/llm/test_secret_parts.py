import random
import string

from octolith.llm import secrets as S

B62 = string.ascii_letters + string.digits


def test_parts_of_runs():
    key, url = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY12", "aB3_dE6-gH9iJ2kL5mN8oP1qR4"
    cases = [
        (f"AWS_ACCESS={key}", key), (f"private_key={key}==", key + "=="), (f"=={key}", key), (f"sig={key}=auth={url}", url),
        (f"api/v1/{url}/x", url), (f"my-name_{key}", key),
    ]
    for text, want in cases:
        assert want in [text[a:b] for a, b in S.covered(text)]
        assert want in [text[c["start"] : c["end"]] for c in S.candidates(f"{text} é", [])]
    assert S.covered(key) == [(0, len(key))] and S.covered(url + "==") == [(0, len(url) + 2)] 
    assert S.candidates("n=" + "1" * 30 + " x", []) == []  # a number is no secret


def test_secrets_with_names_are_redacted(spark):
    rng = random.Random(9)
    plain = ["".join(rng.choices(B62 + "+/", k=40)) for _ in range(60)]
    urls = ["".join(rng.choices(B62 + "-_", k=40)) for _ in range(60)]
    rows = [(k, f"set AWS_SECRET_ACCESS_KEY={x} now") for k, x in enumerate(plain)] + [(100 + k, f"at files/v1/{x}/raw-data now") for k, x in enumerate(urls)]
    out = {r.doc_id: r.text for r in S.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    hidden = sum(x not in out[k] for k, x in enumerate(plain)) + sum(x not in out[100 + k] for k, x in enumerate(urls))
    assert hidden >= 96
    assert out[0].startswith("set AWS_SECRET_ACCESS_KEY=")
