"""hunkmill: a PySpark-native engine for mining code-review change patterns.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns). The subpackages are

* ``functions``  - column expressions over patterns, file names and texts,
* ``operators``  - mining, pattern tables, confidence and trends, overlap, review model, cleaning, diffs, abstraction,
* ``sources``    - tables, JSON, CSV and text files, review services, Git, the review store,
* ``plans``      - lineage, skew, positions and running sums, and the pipeline from diffs to filtered patterns,
* ``streaming``  - trends over a stream of changes,
* ``queries``    - named queries over the test tables with their SQL,
* ``llm``        - operators for training data; nothing outside imports it.
"""

__version__ = "0.2.0"
