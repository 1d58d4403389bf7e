"""No streaming operators.

The modelled analysis works on a finished set of observations (a contest data set over a fixed
period), so there is no stream, watermark or state to build. Fitted ``pyspark.ml`` models in this
package are plain transformers and would score a streaming DataFrame unchanged, but no operator
is added for it.
"""
