"""Operations-metrics analytics as Spark jobs.

Raw server-monitor captures become typed DataFrames and a tagged metric store;
fleet, saturation, capacity, health and partition re-layout questions are
DataFrame plans; the long-running watches are Structured Streaming queries.
"""

__version__ = "0.1.0"
