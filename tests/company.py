"""A small dataset of companies: two domains, sets, four datapoint files, translations."""

import contextlib
import io

from pyspark.sql import types as T

from dimlens.model import Dataset, Resource
from dimlens.session import small_table

CONCEPTS = [
    ("company", "entity_domain", ""),
    ("english_speaking", "entity_set", "company"),
    ("foundation", "entity_set", "company"),
    ("company_size", "entity_set", "company"),
    ("name", "string", ""),
    ("anno", "time", ""),
    ("lines_of_code", "measure", ""),
    ("region", "entity_domain", ""),
    ("country", "string", ""),
    ("num_users", "measure", ""),
    ("latitude", "measure", ""),
    ("longitude", "measure", ""),
    ("full_name", "string", ""),
    ("project", "entity_domain", ""),
    ("domain", "string", ""),
]
COMPANIES = [
    ("nimbus", "Nimbus", "USA", "america", "TRUE", "FALSE"),
    ("orchard", "Orchard", "Sweden", "europe", "TRUE", "TRUE"),
    ("valley", "Valley", "", "europe", "FALSE", "FALSE"),
]
SIZES = [("small", "Not very big", "TRUE"), ("large", "VERY BIG", "TRUE")]
REGIONS = [("america", "All of it"), ("europe", "Part of Eurasia")]
PROJECTS = [("console", "Console"), ("panes", "Panes"), ("suite", "Suite"),
            ("charts", "Charts"), ("server", "Server")]
SIZE_BY_YEAR = [
    ("nimbus", "1975", "small"), ("nimbus", "2015", "large"), ("nimbus", "2016", "large"),
    ("orchard", "2015", "small"), ("orchard", "2016", "small"),
]
CODE_BY_YEAR = [
    ("nimbus", "2015", "62493"), ("nimbus", "2016", "49595"),
    ("orchard", "2015", "496533"), ("orchard", "2016", "531062"),
]
CODE_BY_PROJECT_YEAR = [
    ("nimbus", "console", "2015", "62493"), ("nimbus", "console", "2016", "49595"),
    ("orchard", "server", "2016", "59383"), ("valley", "server", "2016", "9877"),
    ("orchard", "charts", "2015", "439549"), ("orchard", "charts", "2016", "479679"),
    ("orchard", "server", "2015", "56994"), ("valley", "server", "2015", "34857"),
]
USERS_BY_PROJECT = [
    ("nimbus", "panes", "384584", "4", "", ""), ("nimbus", "console", "3985854", "6", "", ""),
    ("nimbus", "suite", "97473", "333", "", ""), ("orchard", "charts", "4893993", "54345", "", ""),
    ("orchard", "server", "4857", "8567", "59.3", "18.1"),
    ("valley", "server", "848547", "5435", "", ""),
]
DUTCH_COMPANIES = [("nimbus", "", "Verenigde Staten"), ("orchard", "Boomgaard", "Zweden"),
                   ("valley", "", "")]
DUTCH_SIZES = [("small", "Niet heel groot"), ("large", "HEEL GROOT")]
DUTCH_SIZE_BY_YEAR = [(c, y, {"small": "klein", "large": "groot"}[s]) for c, y, s in SIZE_BY_YEAR]


def text_table(spark, columns, rows):
    names = columns.split()
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return small_table(spark, schema, rows)


def dataset(spark, **options):
    def rows(columns, data):
        return text_table(spark, columns, data)

    return Dataset(spark, [
        Resource("concepts", ("concept",), rows("concept concept_type domain", CONCEPTS)),
        Resource(
            "companies", ("company",),
            rows("company name country region is--english_speaking is--foundation", COMPANIES),
            {"nl-nl": rows("company name country", DUTCH_COMPANIES)},
        ),
        Resource(
            "sizes", ("company_size",), rows("company_size full_name is--company_size", SIZES),
            {"nl-nl": rows("company_size full_name", DUTCH_SIZES)},
        ),
        Resource("regions", ("region",), rows("region full_name", REGIONS)),
        Resource("projects", ("project",), rows("project name", PROJECTS)),
        Resource(
            "size_by_year", ("company", "anno"), rows("company anno company_size", SIZE_BY_YEAR),
            {"nl-nl": rows("company anno company_size", DUTCH_SIZE_BY_YEAR)},
        ),
        Resource("code_by_year", ("company", "anno"),
                 rows("company anno lines_of_code", CODE_BY_YEAR)),
        Resource("code_by_project_year", ("company", "project", "anno"),
                 rows("company project anno lines_of_code", CODE_BY_PROJECT_YEAR)),
        Resource("users", ("company", "project"),
                 rows("company project lines_of_code num_users latitude longitude",
                      USERS_BY_PROJECT)),
    ], name="firms", **options)


def found(frame):
    """Rows of a result in any order."""
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def listed(frame):
    return [tuple(row) for row in frame.collect()]


def explained(frame, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain(mode)
    return out.getvalue()
