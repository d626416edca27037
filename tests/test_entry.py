import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.columns == ["Kept_At_Suburb", "Total_Registrations", "LatePayment_Count", "LatePayment_Rate",
                          "Discount_Count", "Discount_Rate"]
    rows = df.collect()
    assert len(rows) > 0
    # ordered by late rate, descending
    rates = [r.LatePayment_Rate for r in rows if r.LatePayment_Rate is not None]
    assert rates == sorted(rates, reverse=True)


def test_query_names_are_unique_and_described():
    names = list(E.queries())
    assert len(names) == len(set(names))
    own = [n for n in names if not n.startswith(("op", "pipeline"))]  # those belong to the optional subpackage
    assert all(n[0] in "ced" and n[1:3].isdigit() for n in own)
