"""All registered queries of the core."""

from cortigraph.plans import graphs, pipeline, problems, results, signals, streams, timing, trials

FOUND = {**problems.FOUND, **graphs.FOUND, **signals.FOUND, **timing.FOUND, **results.FOUND, **streams.FOUND, **trials.FOUND, **pipeline.FOUND}
SQL = {**problems.SQL, **graphs.SQL, **signals.SQL, **timing.SQL, **results.SQL, **streams.SQL, **pipeline.SQL}
