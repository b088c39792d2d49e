"""spectraframe: image-collection and table analytics on PySpark DataFrames."""
