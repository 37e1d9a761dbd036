"""kerbside: sensing-exposure analytics and corpus preparation as Spark DataFrame plans."""
