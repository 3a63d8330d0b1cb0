"""All registered queries of the time-series engine and their SQL."""

from pulsegrid.plans import reports, series, signals

QUERIES = {**series.Q, **reports.Q, **signals.Q}
ORACLES = {**series.SQL, **reports.SQL, **signals.SQL}
