"""slateflow.plans"""
