"""tallyframe: checklist-evaluation analytics and text-data operators on Spark DataFrames."""
