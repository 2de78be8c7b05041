"""Stream-static use of the interval operators."""
