"""slateflow.sources"""
