import datetime as dt
import hashlib
import re

import regex

from basketry.llm import pii
from pyspark.sql import functions as F
from tests.llm.fixtures import awkward, empty


def luhn(s):
    digits = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if 2 * d > 9 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def make_card(body):
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(pii.pseudonymise(df, key).collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["pii_kinds"] for r in rows]


VALID = {"card": [make_card("448516811440732"), make_card("411111111111111"), "4111 1111 1111 1111", make_card("60110009901394245")],
         "phone": ["+1 (017) 555-7713", "+49 301 555-0199", "(212) 555-0123"],
         "ipv4": ["97.51.17.173", "255.255.255.255", "0.0.0.1"],
         "ssn": ["123-45-6789", "899-99-9999"],
         "date": ["2024-02-29", "12/31/1999", "29.02.2000", "1800-01-01", "2199-12-31"],
         "email": ["und.34@mail7.example.com", "a_b+c@x-y.co.uk"],
         "secret": ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"']}
SHAPE = {"card": r"[\d ]+", "phone": r"[+()\d \-]+", "ipv4": r"\d{1,3}(\.\d{1,3}){3}", "ssn": r"\d{3}-\d\d-\d{4}",
         "date": r"[\d/.\-]+", "email": r"[a-p]+@mail\.invalid", "secret": r'token = "[0-9a-f]{40}"'}


def test_values_are_replaced_in_their_format_and_stay_valid(spark):
    for kind, values in VALID.items():
        out, kinds = run(spark, [f"before {v}, after" for v in values])
        for v, o, k in zip(values, out, kinds):
            assert k == [kind], (v, k)
            new = o.removeprefix("before ").removesuffix(", after")
            assert new != v and re.fullmatch(SHAPE[kind], new), (v, new)
            if kind in ("card", "phone", "ssn", "date"):
                assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
            if kind == "card":
                assert luhn(new)
            if kind == "ipv4":
                assert all(int(x) <= 255 for x in new.split("."))
            if kind == "date":
                dt.datetime.strptime(new, "%Y-%m-%d" if "-" in v else "%m/%d/%Y" if "/" in v else "%d.%m.%Y")


def test_what_fails_validation_stays(spark):
    texts = ["9807915762804490", "4111 1111 1111 1112", "256.1.1.1", "1.2.3.4.5", "01.2.3.4", "666-11-1111", "000-12-3456",
             "2023-02-29", "13/13/2020", "x4111111111111111", "12345", "version 3, page 17", "a@b", "0000000000000000"]
    out, kinds = run(spark, texts)
    assert out == texts and not any(kinds)


def test_equal_values_stay_linked_and_keys_matter(spark):
    card = VALID["card"][0]
    out, _ = run(spark, [f"{card} {card}", f"paid with {card}."])
    a, b = out[0].split()
    assert a == b and out[1] == f"paid with {a}."
    assert run(spark, [card], "other key")[0][0] != a


def test_feistel_is_a_permutation(spark):
    for a, b in ((3, 7), (10, 10), (189, 773)):
        df = spark.range(a * b).withColumn("p", pii.feistel(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a).cast("long"),
                                                            F.lit(b).cast("long"), "k", "t"))
        assert df.select(F.col("p.left") * b + F.col("p.right")).distinct().count() == a * b
    df = spark.range(10_000).withColumn("d", F.lpad(F.col("id").cast("string"), 4, "0"))
    assert df.select(pii.permute_digits(F.col("d"), "k", "t")).distinct().count() == 10_000


def test_awkward_documents(spark):
    docs = awkward(spark)
    out = pii.pseudonymise(docs, "k")
    assert set(docs.columns) < set(out.columns)
    same = docs.select("doc_id", "text").exceptAll(out.select("doc_id", "text")).count()
    assert same == 0
    assert pii.pseudonymise(empty(spark), "k").count() == 0


MORE = {"phone": ["555-123-4567", "555.123.4567", "555 123 4567", "1-555-123-4567", "+15551234567", "+44 20 7946 0958",
                  "+442079460958", "+33 1 23 45 67 89", "+49 30 1234567", "+45 12 34 56 78", "+44 (0)20 7946 0958",
                  "(212) 555.0123"],
        "card": [f"{c[:4]}{sep}{c[4:10]}{sep}{c[10:]}" for c in (make_card("37828224631000"), make_card("3056930902590"))
                 for sep in " -"],
        "date": ["31/12/1999", "05/12/1999", "7/3/2021", "25/3/2021", "7.3.2021", "1999/12/31", "1999/7/3", "2021-7-3"]}


def date_of(v):
    a, b, c = (int(x) for x in re.split(r"\D", v))
    if a > 31:
        return dt.date(a, b, c)
    return dt.date(c, b, a) if "." in v or a > 12 else dt.date(c, a, b)


def test_other_layouts_are_replaced_in_their_layout(spark):
    for kind, values in MORE.items():
        out, kinds = run(spark, [f"before {v}, after" for v in values])
        for v, o, k in zip(values, out, kinds):
            new = o.removeprefix("before ").removesuffix(", after")
            assert k == [kind] and new != v, (v, o, k)
            if kind == "date":
                date_of(new)
                assert re.sub(r"\d+", "9", new) == re.sub(r"\d+", "9", v)
                if not re.search(r"\b\d\b", v):
                    assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
                assert (int(re.split(r"\D", new)[0]) > 12) == (int(re.split(r"\D", v)[0]) > 12) or "/" not in v[:3]
            else:
                assert re.sub(r"\d", "9", new) == re.sub(r"\d", "9", v)
            if kind == "card":
                assert luhn(new)


def test_other_layouts_that_fail_validation_stay(spark):
    texts = ["3782 822463 10006", "31/02/1999", "32/12/1999", "13.13.2021", "1999/13/01", "2021-2-30", "x555-123-4567",
             "555-123-45678", "555-123.4567", "+1234567", "10.555.123.4567", "3/4/21"]
    out, kinds = run(spark, texts)
    assert out == texts and not any(kinds)


def test_equal_phones_and_dates_stay_linked_over_layouts(spark):
    out, _ = run(spark, ["+44 20 7946 0958", "+442079460958", "555-123-4567", "+1 (555) 123-4567", "+1 555 123 4567 2024",
                         "7/3/2021", "2021-07-03", "3.7.2021"])
    digits = [re.sub(r"\D", "", o) for o in out]
    assert digits[0] == digits[1] and digits[0].startswith("44")
    assert digits[3] == "1" + digits[2] and digits[4] == digits[3] + "2024"
    assert len({date_of(o) for o in out[5:]}) == 1


def test_late_days_are_permuted_among_themselves(spark):
    start = F.lit(pii.CYCLE_START).cast("date")
    days = spark.range(pii.CYCLE_DAYS).select(F.date_add(start, F.col("id").cast("int")).alias("d")).where("day(d) > 12")
    new = days.select(pii.permute_late_day(F.col("d"), "k").alias("d"))
    assert days.count() == pii.LATE_DAYS
    assert new.distinct().count() == pii.LATE_DAYS and new.exceptAll(days).count() == 0


def test_timestamps_ranges_and_other_separators(spark):
    texts = ["at 2024-01-01T10:00:00Z.", "1/2/2020-3/4/2020", "2020-01-02/2020-03-04", "call 555-123-4567/8 now",
             "4111.1111.1111.1111", "2024-01-01T10:00:00Z/2024-02-01T10:00:00Z", "1.2.2020-3.4.2020"]
    out, kinds = run(spark, texts)
    assert kinds == [["date"], ["date"] * 2, ["date"] * 2, ["phone"], ["card"], ["date"] * 2, ["date"] * 2]
    assert out[0] != texts[0] and re.fullmatch(r"at \d{4}-\d\d-\d\dT10:00:00Z\.", out[0])
    for k in (1, 2, 6):
        a, b = re.split("/" if k == 2 else "-", texts[k])
        new = re.split("/" if k == 2 else "-", out[k])
        assert len(new) == 2 and new[0] != a and new[1] != b
    assert out[3].endswith("/8 now") and luhn(out[4]) and out[4] != texts[4]
    # equal dates stay linked, with a time of day or without
    pair, _ = run(spark, ["2024-01-01T10:00:00Z", "2024-01-01"])
    assert pair[0] == pair[1] + "T10:00:00Z"


def test_parts_of_longer_numbers_stay(spark):
    texts = ["2024-01-01T1", "2024-01-01Tea", "2024-01-012", "1/2/2020-3", "1/2/2020-3/4/20201", "2020-01-02/2020",
             "555-123-4567/89012", "555-123-4567/8/9", "1/2/2020/3/4/2020", "v2024-01-01"]
    out, kinds = run(spark, texts)
    assert out == texts and not any(kinds)


# -- a second implementation, in plain Python (the shapes of candidates are taken as given) ------------

def py_keyed(key, kind, *parts):
    return hashlib.sha256("|".join([key, kind, *map(str, parts)]).encode()).hexdigest()


def py_feistel(left, right, a, b, key, kind):
    for i in range(8):
        if i % 2 == 0:
            left = (left + int(py_keyed(key, kind, i, right, a, b)[:15], 16)) % a
        else:
            right = (right + int(py_keyed(key, kind, i, left, a, b)[:15], 16)) % b
    return left, right


def py_digits(d, key, kind):
    low = len(d) // 2
    high = len(d) - low
    x, y = py_feistel(int(d[:high]), int(d[high:]), 10 ** high, 10 ** low, key, kind)
    return f"{x:0{high}d}{y:0{low}d}"


def py_lay(value, digits):
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in value)


CYCLE = [dt.date(1800, 1, 1) + dt.timedelta(k) for k in range(146_097)]
LATE = [d for d in CYCLE if d.day > 12]


def py_date(value, key):
    a, b, c = re.split(r"\D", value)
    year_first, slash = len(a) == 4, value[len(a)] == "/"
    day_first = not year_first and (not slash or int(a) > 12)
    y, m, d = (a, b, c) if year_first else (c, b, a) if day_first else (c, a, b)
    try:
        old = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    if not CYCLE[0] <= old <= CYCLE[-1]:
        return None
    if day_first and slash:
        r = LATE.index(old)
        x, z = py_feistel(r // 9833, r % 9833, 9, 9833, key, "late date")
        new = LATE[x * 9833 + z]
    else:
        r = (old - CYCLE[0]).days
        x, z = py_feistel(r // 773, r % 773, 189, 773, key, "date")
        new = CYCLE[x * 773 + z]
    width = 2 if len(m) == len(d) == 2 else 1
    md, dd, yy, sep = f"{new.month:0{width}d}", f"{new.day:0{width}d}", f"{new.year:04d}", value[len(a)]
    return sep.join((yy, md, dd) if year_first else (dd, md, yy) if day_first else (md, dd, yy))


def py_value(v, key):
    """(pseudonym, kind) of a candidate; (v, None) if it is not valid."""
    d = re.sub(r"\D", "", v)
    if "@" in v:
        return py_keyed(key, "email", v.lower())[:16].translate(str.maketrans("0123456789", "ghijklmnop")) + "@mail.invalid", "email"
    if '"' in v or "'" in v:
        at = max(v.rfind('"'), v.rfind("'")) + 1
        return v[:at] + (py_keyed(key, "secret", v[at:]) + py_keyed(key, "secret2", v[at:]))[:len(v) - at], "secret"
    groups = re.split(r"\D+", v)
    if v[0] == "+" or "(" in v or [len(g) for g in groups[-3:]] == [3, 3, 4]:
        code = 0
        if v[0] == "+":
            first = groups[1]
            one, two = (re.match(x, first) for x in pii.SHORT_CODES)
            code = len(first) if len(first) <= 3 else 1 if one else 2 if two else 3
        n = min(10, len(d) - code)
        return py_lay(v, d[:-n] + py_digits(d[-n:], key, "phone")), "phone"
    if v.count(".") == 3 and max(map(len, groups)) <= 3:
        if any(int(g) > 255 or (len(g) > 1 and g[0] == "0") for g in groups):
            return v, None
        o = [int(g) for g in groups]
        x, y = py_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}", "ipv4"
    if len(groups) == 3 and sorted(map(len, groups))[1] <= 2 and max(map(len, groups)) == 4 and [len(g) for g in groups] != [3, 2, 4]:
        new = py_date(v, key)
        return (new, "date") if new else (v, None)
    if [len(g) for g in groups] == [3, 2, 4]:
        area, group, serial = map(int, groups)
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return v, None
        x, y = py_feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
        return f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}", "ssn"
    if luhn(d) and d.strip("0"):
        body = py_digits(d[:-1], key, "card")
        return py_lay(v, make_card(body)), "card"
    return v, None


def py_pseudonymise(text, key):
    kinds = []

    def put(m):
        new, kind = py_value(m[0], key)
        kinds.extend([kind] if kind else [])
        return new

    return (None if text is None else regex.sub(pii.CANDIDATE, put, text, flags=regex.V0)), kinds


def test_whole_texts_equal_the_plain_version(spark, sf_dir):
    values = [v for group in (VALID, MORE) for vs in group.values() for v in vs]
    texts = [None, "", "no value", "; ".join(values), "\n".join(f"<{v}> and ({v})" for v in values),
             "3782 822463 10006, 31/02/1999, 256.1.1.1, 666-11-1111, 2023-02-29, 13/13/2020",
             "2024-01-01T10:00:00Z 1/2/2020-3/4/2020 555-123-4567/8 4111.1111.1111.1111 2020-1-2/2020-3-4"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    out, kinds = run(spark, texts)
    want = [py_pseudonymise(t, "k") for t in texts]
    assert out == [t for t, _ in want] and kinds == [k for _, k in want]
    assert sum(map(len, kinds)) > 100
