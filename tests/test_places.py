"""The three places end to end on small files, against the same steps in pandas."""

import numpy as np
import pandas as pd
import pytest

from almanaq import fixed
from almanaq.plans import places

MONTHS = range(1, 13)


def months(first, last, last_month=12):
    return [(y, m) for y in range(first, last + 1) for m in MONTHS if y < last or m <= last_month]


def z(s):
    return (s - s.mean()) / s.std(ddof=1)


def wide_temperature(names, rng, encoding="utf-8", with_name=True):
    cols = [f"{y}-{m:02d}" for y, m in months(2005, 2025)]
    rows = {n: 20 + 3 * np.sin(np.arange(len(cols)) / 12 * 6.28) + rng.normal(size=len(cols)) for n in names}
    head = ["code"] + (["name"] if with_name else []) + cols
    lines = [",".join(head)] + [",".join([f"C{i}"] + ([n] if with_name else []) + [f"{v:.6f}" for v in vs]) for i, (n, vs) in enumerate(rows.items())]
    long = pd.DataFrame([(n, int(c[:4]), int(c[5:]), float(f"{v:.6f}")) for n, vs in rows.items() for c, v in zip(cols, vs)],
                        columns=["name", "year", "month", "temperature"])
    return "\n".join(lines).encode(encoding) + b"\n", long


def national(rain, inc, temp, by):
    rain = rain.assign(rainfall_deviation=rain.rfh - rain.groupby("month").rfh.transform("mean"))
    s = inc.groupby("year").incidents.transform(z)
    inc = inc.assign(incident_deviation=s - s.groupby(inc.month).transform("mean"))
    temp = temp.assign(temperature_deviation=temp.temperature - temp.groupby("month").temperature.transform("mean"))
    out = rain.merge(inc, on=["year", "month"]).merge(temp, on=["year", "month"])
    for c in ("rainfall", "incident", "temperature"):
        col = out[f"{c}_deviation"]
        out[f"scaled_{c}_deviation"] = col.groupby(out.month).transform(z) if by else z(col)
    return out


def unit_panel(rain, inc, temp, unit):
    rain = rain.assign(rainfall_deviation=rain.rfh - rain.groupby([unit, "month"]).rfh.transform("mean"))
    f = rain[rain.year >= 2003][["year", "month", unit]].merge(inc, on=["year", "month", unit], how="left").fillna({"incidents": 0})
    f["s"] = f.groupby("year").incidents.transform(z)
    f["incident_deviation"] = f.s - f.groupby([unit, "month"]).s.transform("mean")
    out = rain.merge(f, on=["year", "month", unit])
    temp = temp.assign(temperature_deviation=temp.temperature - temp.groupby([unit, "month"]).temperature.transform("mean"))
    out = out.merge(temp, on=["year", "month", unit], how="left")
    for c in ("rainfall", "incident", "temperature"):
        out[f"scaled_{c}_deviation"] = z(out[f"{c}_deviation"])
    return out


SCALED = [f"scaled_{c}_deviation" for c in ("rainfall", "incident", "temperature")]


def assert_panel(got, want, keys):
    got, want = (d.sort_values(keys)[keys + SCALED].reset_index(drop=True) for d in (got.toPandas(), want))
    assert len(got) == len(want)
    for k in keys:
        assert list(got[k]) == list(want[k])
    np.testing.assert_allclose(got[SCALED].to_numpy(float), want[SCALED].to_numpy(float), atol=1e-9)


def test_colombia(spark, tmp_path):
    rng = np.random.default_rng(1)
    codes = ["CO05001", "CO05002", "CO25001", "CO25899"]
    rain = pd.DataFrame([(f"{y}-{m:02d}-{d:02d}", c, round(float(rng.gamma(2, 20)), 3)) for y, m in months(2016, 2025, 2) for d in (1, 11, 21) for c in codes],
                        columns=["date", "ADM2_PCODE", "rfh"])
    rain.iloc[:300].to_csv(tmp_path / "r1.csv", index=False)
    rain.iloc[300:].to_csv(tmp_path / "r2.csv", index=False)
    ev = pd.DataFrame([(f"{int(rng.integers(1, 28))}/{m:02d}/{y}", int(rng.integers(1, 4)), c // 1000, c)
                       for y, m in months(2016, 2025, 2) for c in (5001, 5002, 25001) for _ in range(int(rng.integers(0, 4)) + (c == 5001))] + [("31/02/2020", 50, 5, 5001)],
                      columns=["FECHA HECHO", "CANTIDAD", "COD_DEPTO", "COD_MUNI"])
    ev.to_csv(tmp_path / "e.csv", index=False)
    raw, temp = wide_temperature(["Colombia", "Uno", "Dos", "Tres"], rng)
    (tmp_path / "t.csv").write_bytes(raw)
    (tmp_path / "g.csv").write_text("name,MPIO_CCDGO\nUno,5001\nDos,5002\nTres,25001\n")
    cells = places.colombia_cells(spark, [str(tmp_path / "r1.csv"), str(tmp_path / "r2.csv")], *[str(tmp_path / f"{n}.csv") for n in "etg"])

    rain["year"], rain["month"] = rain.date.str[:4].astype(int), rain.date.str[5:7].astype(int)
    rain["COD_MUNI"] = rain.ADM2_PCODE.str[2:].astype(int)
    ev = ev[ev["FECHA HECHO"] != "31/02/2020"].copy()
    ev["year"], ev["month"] = ev["FECHA HECHO"].str[-4:].astype(int), ev["FECHA HECHO"].str[-7:-5].astype(int)
    total = lambda d, keys, col: d.groupby(keys)[col].sum().reset_index()
    ym = ["year", "month"]
    inc = total(ev, ym, "CANTIDAD").rename(columns={"CANTIDAD": "incidents"})
    want = national(total(rain, ym, "rfh"), inc, temp[temp.name == "Colombia"], ["month"])
    tables = places.national_tables(cells["national"], places.COLOMBIA)
    assert_panel(tables["panel"], want, ym)
    fit = want[want.year != 2025]
    x = np.hstack([fit[[SCALED[0], SCALED[2]]].to_numpy(), pd.get_dummies(fit.year).to_numpy(float)])
    beta = np.linalg.lstsq(x, fit[SCALED[1]].to_numpy(), rcond=None)[0]
    np.testing.assert_allclose(tables["fe"].toPandas().estimate, beta[:2], atol=1e-9)
    assert all(tables[n].count() > 0 for n in tables)

    towns = temp.merge(pd.DataFrame({"name": ["Uno", "Dos", "Tres"], "COD_MUNI": [5001, 5002, 25001]}), on="name")
    by_town = unit_panel(total(rain, [*ym, "COD_MUNI"], "rfh"), total(ev, [*ym, "COD_MUNI"], "CANTIDAD").rename(columns={"CANTIDAD": "incidents"}), towns, "COD_MUNI")
    muni = places.unit_tables(cells["COD_MUNI"], "COD_MUNI")
    assert_panel(muni["panel"], by_town, ["COD_MUNI", *ym])
    # The town without a temperature is in the panel but not in the models.
    assert {r["COD_MUNI"] for r in muni["slopes"].collect()} == {5001, 5002, 25001}
    assert muni["profile"].count() == 4 * 12
    dep = places.unit_tables(cells["COD_DEPTO"], "COD_DEPTO")
    assert set(dep) == {"panel", "profile"} and dep["profile"].count() == 24

    corner = lambda code, name, x: [(code, name, 1, i, x + a, 4.0 + b) for i, (a, b) in enumerate([(0., 0.), (1., 0.), (1., 1.), (0., 1.), (0., 0.)])]
    polygons = spark.createDataFrame(
        corner("05001", "Uno", -75.0) + corner("25899", "Cuatro", -74.0) + corner("99001", "Leer", -73.0),
        "MPIO_CCDGO string, MPIO_CNMBR string, ring int, seq int, lon double, lat double")
    mapped = {r["COD_MUNI"]: r for r in places.colombia_unit_map(muni["profile"], polygons, muni["slopes"]).collect()}
    assert set(mapped) == {5001, 5002, 25001, 25899}
    assert mapped[5001]["estimate"] is None and mapped[5001]["lon"] == pytest.approx(-74.5, abs=1e-6)
    assert mapped[5002]["estimate"] is not None and mapped[5002]["MPIO_CNMBR"] is None
    parents = spark.createDataFrame([("05",), ("99",)], "DPTO_CCDGO string")
    parent_map = places.colombia_parent_map(dep["profile"], parents)
    assert parent_map.count() == 25


def test_mexico(spark, tmp_path):
    rng = np.random.default_rng(2)
    codes = {"MX01": "AGUASCALIENTES", "MX15": "MEXICO", "MX16": "MICHOACAN", "MX32": "ZACATECAS"}
    rain = pd.DataFrame([(f"{y}-{m:02d}-{d:02d}", lv, c if lv == 1 else c + "001", round(float(rng.gamma(2, 20)), 3))
                         for y, m in months(2011, 2025, 3) for d in (1, 11, 21) for c in codes for lv in (1, 2)],
                        columns=["#date", "#adm+level+level", "#adm+code", "#indicator+rfh+num"])
    rain.to_csv(tmp_path / "r.csv", index=False)
    caps = [m for m in fixed.SPANISH_MONTHS]
    old_rows = [(y, n, k, *rng.integers(1, 90, 12)) for y in range(2011, 2018) for n in ("AGUASCALIENTES", "MEXICO", "MICHOACAN", "ZACATECAS") for k in ("HOMICIDIOS", "ROBO")]
    old = pd.DataFrame(old_rows, columns=["ANO", "ENTIDAD", "MODALIDAD", *caps])
    old.to_csv(tmp_path / "old.csv", index=False)
    low = [m.capitalize() for m in caps]
    new_rows = [(y, n, k, *rng.integers(1, 90, 12)) for y in range(2015, 2026) for n in ("Aguascalientes", "México", "Michoacán de Ocampo", "Zacatecas") for k in ("Homicidio", "Robo") for _ in range(2)]
    new = pd.DataFrame(new_rows, columns=["Ano", "Entidad", "Tipo de delito", *low])
    new.to_csv(tmp_path / "new.csv", index=False, encoding="latin-1")
    raw, temp = wide_temperature(["Mexico", "Aguascalientes", "M\x82xico", "Michoac n de Ocampo", "Zacatecas"], rng, "latin-1")
    (tmp_path / "t.csv").write_bytes(raw)
    cells = places.mexico_cells(spark, [str(tmp_path / "r.csv")], *[str(tmp_path / f) for f in ("old.csv", "new.csv", "t.csv")])

    ym = ["year", "month"]
    rain.columns = ["date", "level", "code", "rfh"]
    rain = rain[rain.level == 1].copy()
    rain["year"], rain["month"], rain["ENTIDAD"] = rain.date.str[:4].astype(int), rain.date.str[5:7].astype(int), rain.code.map(codes)
    long = lambda d, cols, year, name: d.melt([year, name], cols, "m", "incidents").assign(month=lambda f: f.m.map({c: i for i, c in enumerate(cols, 1)})).rename(columns={year: "year", name: "ENTIDAD"})
    o = long(old[old.MODALIDAD == "HOMICIDIOS"], caps, "ANO", "ENTIDAD").query("year < 2015")
    n = long(new[new["Tipo de delito"] == "Homicidio"], low, "Ano", "Entidad")
    total = lambda d, keys, col: d.groupby(keys)[col].sum().reset_index()
    whole = pd.concat([o[o.ENTIDAD != "MEXICO"], n[n.ENTIDAD != "México"]])
    want = national(total(rain, ym, "rfh"), total(whole, ym, "incidents"), temp[temp.name == "Mexico"], ["month"])
    tables = places.national_tables(cells["national"], places.MEXICO)
    assert_panel(tables["panel"], want, ym)
    assert all(tables[t].count() > 0 for t in tables)

    states = {"Aguascalientes": "AGUASCALIENTES", "Michoacán de Ocampo": "MICHOACAN", "Zacatecas": "ZACATECAS"}
    both = pd.concat([o, n.assign(ENTIDAD=n.ENTIDAD.map(states)).dropna()])
    warm = temp[temp.name != "Mexico"].assign(ENTIDAD=lambda d: d.name.map({
        "Aguascalientes": "AGUASCALIENTES", "M\x82xico": "MEXICO", "Michoac n de Ocampo": "MICHOACAN", "Zacatecas": "ZACATECAS"}))
    by_state = unit_panel(total(rain, [*ym, "ENTIDAD"], "rfh"), total(both, [*ym, "ENTIDAD"], "incidents"), warm, "ENTIDAD")
    panel = places.unit_tables(cells["ENTIDAD"], "ENTIDAD")
    assert_panel(panel["panel"], by_state, ["ENTIDAD", *ym])
    # The state whose key the newer lookup lacks counts as zero from the splice on.
    gone = by_state[(by_state.ENTIDAD == "MEXICO") & (by_state.year >= 2015)]
    assert (gone.incidents == 0).all()
    polygons = spark.createDataFrame([("Zacatecas", None), ("México", "Mexico"), ("Nowhere", None)], "ADM1_ES string, ADM1_REF string")
    mapped = {r["ADM1_ES"]: r for r in places.mexico_map(polygons, panel["slopes"]).collect()}
    assert mapped["Zacatecas"]["estimate"] is not None and mapped["Mexico"]["ENTIDAD"] == "MEXICO" and mapped["Nowhere"]["estimate"] is None


def test_city(spark, tmp_path):
    rng = np.random.default_rng(3)
    rain = pd.DataFrame([(f"01-{m:02d}-{y}", round(float(rng.gamma(2, 2)), 3)) for y, m in months(2009, 2025, 3)], columns=["date", "value"])
    rain.to_csv(tmp_path / "r.csv", index=False)
    kinds = ["Battery", "Robbery", "Battery - Domestic", "Assault by Computer", "Theft", "Homicide"]
    ev = pd.DataFrame([(kinds[int(rng.integers(0, 6))], f"{m:02d}/{int(rng.integers(1, 28)):02d}/{y} 04:05:06 PM") for y, m in months(2010, 2025, 3) for _ in range(8)],
                      columns=["Incident Type", "Report Date"])
    ev.to_csv(tmp_path / "e.csv", index=False)
    raw, temp = wide_temperature(["x"], rng, with_name=False)
    (tmp_path / "t.csv").write_bytes(raw)
    cells = places.city_cells(spark, *[str(tmp_path / f"{n}.csv") for n in "ret"])

    rain["year"], rain["month"] = rain.date.str[-4:].astype(int), rain.date.str[3:5].astype(int)
    ev["year"], ev["month"] = ev["Report Date"].str[6:10].astype(int), ev["Report Date"].str[:2].astype(int)
    ev = ev[ev["Incident Type"].isin(["Battery", "Robbery", "Homicide"]) & (ev.year != 2025)]
    grid = pd.DataFrame(months(2011, 2024), columns=["year", "month"])
    inc = ev.groupby(["year", "month"]).size().reset_index(name="incidents").merge(grid, how="outer").fillna(0)
    want = national(rain[rain.year != 2025].rename(columns={"value": "rfh"}), inc, temp, [])
    tables = places.national_tables(cells["national"], places.CITY)
    assert_panel(tables["panel"], want, ["year", "month"])
    assert all(tables[t].count() > 0 for t in tables)
    assert {r["period"] for r in tables["rainfall_densities"].select("period").distinct().collect()} == {"2006–2010", "2011–2015", "2016–2020", "2021–2024"}
