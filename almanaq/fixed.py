"""Fixed values.

Everything in this module must equal the published analysis for results to agree: names, word lists, lookup rows,
period labels and cut years. Nothing here is derived; change a value and the numbers change.
"""

# English month names, in calendar order.
MONTH_NAMES = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# Spanish month names in capitals, in calendar order.
SPANISH_MONTHS = (
    "ENERO", "FEBRERO", "MARZO", "ABRIL", "MAYO", "JUNIO",
    "JULIO", "AGOSTO", "SEPTIEMBRE", "OCTUBRE", "NOVIEMBRE", "DICIEMBRE",
)

# Direction labels of a deviation.
ABOVE, BELOW = "Above", "Below"

# Text patterns.
CLOCK_PATTERN = r"\s+\d{1,2}:\d{2}:\d{2}\s*(AM|PM)"
MONTH_COLUMN_PATTERN = r"^X\d{4}\.\d{2}$"

# Term lists of the incident text filters.
SERIOUS_VIOLENCE_TERMS = (
    "Homicide", "Battery", "Assault", "Robbery", "Affray", "With Violence",
    "False Imprisonment", "Extortion", "Child Molestation", "Striking a Police Animal",
)
CYBER_TERMS = ("Cyber", "Computer", "Fraud", "Calls", "Written Threat", "Stalking", "Sexting")
DOMESTIC_TERMS = ("Domestic", "Dating", "Non-reporting Sexual Battery Kit")

# Labelled year ranges (label, first year, last year), both ends included.
MEASURE_PERIODS = (
    ("1981–1985", 1981, 1985),
    ("1986–1990", 1986, 1990),
    ("1991–1995", 1991, 1995),
    ("1996–2000", 1996, 2000),
    ("2001–2005", 2001, 2005),
    ("2006–2010", 2006, 2010),
    ("2011–2015", 2011, 2015),
    ("2016–2020", 2016, 2020),
    ("2021–2024", 2021, 2024),
)
# The city's first label has a hyphen, the others an en dash.
CITY_MEASURE_PERIODS = (("1900-1980", 1900, 1980),) + MEASURE_PERIODS
COLOMBIA_COUNT_PERIODS = (
    ("2003–2005", 2003, 2005),
    ("2006–2010", 2006, 2010),
    ("2011–2015", 2011, 2015),
    ("2016–2020", 2016, 2020),
    ("2021–2024", 2021, 2024),
)
MEXICO_COUNT_PERIODS = (
    ("1997–2000", 1997, 2000),
    ("2001–2005", 2001, 2005),
    ("2006–2010", 2006, 2010),
    ("2011–2015", 2011, 2015),
    ("2016–2020", 2016, 2020),
    ("2021–2024", 2021, 2024),
)
CITY_COUNT_PERIODS = (
    ("2011–2015", 2011, 2015),
    ("2016–2020", 2016, 2020),
    ("2021–2024", 2021, 2024),
)

# Cut years.
PARTIAL_YEAR = 2025
SKELETON_FROM = 2003
PROFILE_YEARS = (2022, 2025)  # first year included, last year excluded
SPLICE_YEAR = 2015
CITY_YEARS = (2011, 2024)
CITY_TEMPERATURE_FROM = 1984
COLOMBIA_TREND_FROM = 2003
MEXICO_TREND_FROM = 1997
CITY_TREND_FROM = 2011

# Administrative code -> state name.
STATE_BY_CODE = (
    ("MX01", "AGUASCALIENTES"),
    ("MX02", "BAJA CALIFORNIA"),
    ("MX03", "BAJA CALIFORNIA SUR"),
    ("MX04", "CAMPECHE"),
    ("MX05", "COAHUILA DE ZARAGOZA"),
    ("MX06", "COLIMA"),
    ("MX07", "CHIAPAS"),
    ("MX08", "CHIHUAHUA"),
    ("MX09", "CIUDAD DE MEXICO"),
    ("MX10", "DURANGO"),
    ("MX11", "GUANAJUATO"),
    ("MX12", "GUERRERO"),
    ("MX13", "HIDALGO"),
    ("MX14", "JALISCO"),
    ("MX15", "MEXICO"),
    ("MX16", "MICHOACAN"),
    ("MX17", "MORELOS"),
    ("MX18", "NAYARIT"),
    ("MX19", "NUEVO LEON"),
    ("MX20", "OAXACA"),
    ("MX21", "PUEBLA"),
    ("MX22", "QUERETARO"),
    ("MX23", "QUINTANA ROO"),
    ("MX24", "SAN LUIS POTOSI"),
    ("MX25", "SINALOA"),
    ("MX26", "SONORA"),
    ("MX27", "TABASCO"),
    ("MX28", "TAMAULIPAS"),
    ("MX29", "TLAXCALA"),
    ("MX30", "VERACRUZ"),
    ("MX31", "YUCATAN"),
    ("MX32", "ZACATECAS"),
)

# State name in the newer incident file (Latin-1 accents) -> state name.
# "MX15" stands where the accented name of that state belongs; kept as given, so its rows from the newer file do not
# match (see panel.unmatched_keys).
STATE_BY_INCIDENT_NAME = (
    ("Aguascalientes", "AGUASCALIENTES"),
    ("Baja California", "BAJA CALIFORNIA"),
    ("Baja California Sur", "BAJA CALIFORNIA SUR"),
    ("Campeche", "CAMPECHE"),
    ("Coahuila de Zaragoza", "COAHUILA DE ZARAGOZA"),
    ("Colima", "COLIMA"),
    ("Chiapas", "CHIAPAS"),
    ("Chihuahua", "CHIHUAHUA"),
    ("Ciudad de México", "CIUDAD DE MEXICO"),
    ("Durango", "DURANGO"),
    ("Guanajuato", "GUANAJUATO"),
    ("Guerrero", "GUERRERO"),
    ("Hidalgo", "HIDALGO"),
    ("Jalisco", "JALISCO"),
    ("MX15", "MEXICO"),
    ("Michoacán de Ocampo", "MICHOACAN"),
    ("Morelos", "MORELOS"),
    ("Nayarit", "NAYARIT"),
    ("Nuevo León", "NUEVO LEON"),
    ("Oaxaca", "OAXACA"),
    ("Puebla", "PUEBLA"),
    ("Querétaro", "QUERETARO"),
    ("Quintana Roo", "QUINTANA ROO"),
    ("San Luis Potosí", "SAN LUIS POTOSI"),
    ("Sinaloa", "SINALOA"),
    ("Sonora", "SONORA"),
    ("Tabasco", "TABASCO"),
    ("Tamaulipas", "TAMAULIPAS"),
    ("Tlaxcala", "TLAXCALA"),
    ("Veracruz de Ignacio de la Llave", "VERACRUZ"),
    ("Yucatán", "YUCATAN"),
    ("Zacatecas", "ZACATECAS"),
)

# State name in the temperature file -> state name. The file has DOS code page bytes, read here one byte
# per character. Two keys hold a plain space where the accented letter was; kept as given.
STATE_BY_TEMPERATURE_NAME = (
    ("Aguascalientes", "AGUASCALIENTES"),
    ("Baja California", "BAJA CALIFORNIA"),
    ("Baja California Sur", "BAJA CALIFORNIA SUR"),
    ("Campeche", "CAMPECHE"),
    ("Coahuila de Zaragoza", "COAHUILA DE ZARAGOZA"),
    ("Colima", "COLIMA"),
    ("Chiapas", "CHIAPAS"),
    ("Chihuahua", "CHIHUAHUA"),
    ("Ciudad de M\x82xico", "CIUDAD DE MEXICO"),
    ("Durango", "DURANGO"),
    ("Guanajuato", "GUANAJUATO"),
    ("Guerrero", "GUERRERO"),
    ("Hidalgo", "HIDALGO"),
    ("Jalisco", "JALISCO"),
    ("M\x82xico", "MEXICO"),
    ("Michoac n de Ocampo", "MICHOACAN"),
    ("Morelos", "MORELOS"),
    ("Nayarit", "NAYARIT"),
    ("Nuevo Le\xa2n", "NUEVO LEON"),
    ("Oaxaca", "OAXACA"),
    ("Puebla", "PUEBLA"),
    ("Quer\x82taro", "QUERETARO"),
    ("Quintana Roo", "QUINTANA ROO"),
    ("San Luis Potos\xa1", "SAN LUIS POTOSI"),
    ("Sinaloa", "SINALOA"),
    ("Sonora", "SONORA"),
    ("Tabasco", "TABASCO"),
    ("Tamaulipas", "TAMAULIPAS"),
    ("Tlaxcala", "TLAXCALA"),
    ("Veracruz de Ignacio de la Llave", "VERACRUZ"),
    ("Yucat n", "YUCATAN"),
    ("Zacatecas", "ZACATECAS"),
)

# State name in the polygon file -> state name.
STATE_BY_POLYGON_NAME = (
    ("Aguascalientes", "AGUASCALIENTES"),
    ("Baja California", "BAJA CALIFORNIA"),
    ("Baja California Sur", "BAJA CALIFORNIA SUR"),
    ("Campeche", "CAMPECHE"),
    ("Coahuila de Zaragoza", "COAHUILA DE ZARAGOZA"),
    ("Colima", "COLIMA"),
    ("Chiapas", "CHIAPAS"),
    ("Chihuahua", "CHIHUAHUA"),
    ("Distrito Federal", "CIUDAD DE MEXICO"),
    ("Durango", "DURANGO"),
    ("Guanajuato", "GUANAJUATO"),
    ("Guerrero", "GUERRERO"),
    ("Hidalgo", "HIDALGO"),
    ("Jalisco", "JALISCO"),
    ("Mexico", "MEXICO"),
    ("Michoacan de Ocampo", "MICHOACAN"),
    ("Morelos", "MORELOS"),
    ("Nayarit", "NAYARIT"),
    ("Nuevo Leon", "NUEVO LEON"),
    ("Oaxaca", "OAXACA"),
    ("Puebla", "PUEBLA"),
    ("Queretaro de Arteaga", "QUERETARO"),
    ("Quintana Roo", "QUINTANA ROO"),
    ("San Luis Potosi", "SAN LUIS POTOSI"),
    ("Sinaloa", "SINALOA"),
    ("Sonora", "SONORA"),
    ("Tabasco", "TABASCO"),
    ("Tamaulipas", "TAMAULIPAS"),
    ("Tlaxcala", "TLAXCALA"),
    ("Veracruz de Ignacio de la Llave", "VERACRUZ"),
    ("Yucatan", "YUCATAN"),
    ("Zacatecas", "ZACATECAS"),
)

# Row filters of the place scripts.
COUNTRY_NAMES = {"colombia": "Colombia", "mexico": "Mexico"}
OLD_INCIDENT_KIND, NEW_INCIDENT_KIND = "HOMICIDIOS", "Homicidio"
OLD_DROPPED_STATE, NEW_DROPPED_STATE = "MEXICO", "México"
STATE_LEVEL = "1"
