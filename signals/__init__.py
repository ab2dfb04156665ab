"""Customer and revenue analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames, with column names as parameters:

* ``functions``  column expressions (parsing, calendar, binning, display labels)
* ``sources``    readers, writers, raw sheets, shared scratch tables, model files
* ``operators``  cleaning, quality, profiles, panels, ranking, forecasting, drift, masking
* ``plans``      the weekly batch steps composed from the operators
* ``catalog``    the registered queries and their reference SQL
"""
